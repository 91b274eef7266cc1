"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

__all__ = ["cut_lineage", "prepare", "documents", "slices", "texts_of", "utf8_of", "crc_fold", "sum_blobs", "filter_rows", "row_keyed", "drop_keys", "union_all"]

#: Bytes of text handed to a Python worker at once.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers and bound the Arrow
    batches by bytes, so that long texts don't pile up in one batch."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20, max_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``max_bytes`` of ``column``; a
    single longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def utf8_of(values: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def texts_of(values: pa.Array) -> list[str]:
    """The texts as str, null as empty; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return ["" if v is None else v for v in values.to_pylist()]
    except UnicodeDecodeError:
        return [v.decode("utf-8", "replace") for v in utf8_of(values)]


def crc_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds,
                      F.lit(-1)).cast("int")


def sum_blobs(parts: DataFrame, dtype: str = "float64") -> bytes | None:
    """Sum of the equally long numeric arrays in the binary column ``blob``.

    ``parts`` has a row (``part`` int, ``blob`` binary) for each task. The parts
    are added up in as many groups as the cluster has cores, then the group
    sums, a task adding one array at a time; one array reaches the driver. Null
    where ``parts`` has no rows.
    """
    import numpy as np
    import pandas as pd

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for b in f["blob"]:
                x = np.frombuffer(b, dtype)
                total = x.copy() if total is None else np.add(total, x, out=total)
        if total is not None:
            yield pd.DataFrame({"part": [0], "blob": [total.tobytes()]})

    groups = max(1, parts.sparkSession.sparkContext.defaultParallelism)
    first = parts.repartition(groups, F.col("part") % groups).mapInPandas(add, "part int, blob binary")
    rows = first.repartition(1).mapInPandas(add, "part int, blob binary").select("blob").collect()
    return bytes(rows[0][0]) if rows else None


def filter_rows(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows whose texts ``keep`` marks, with all columns as they came; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(keep(part.column(text_col)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def row_keyed(docs: DataFrame) -> DataFrame:
    """(``__row``, ``__doc``): a key that names each row for good, and the row. A
    Parquet table as read has one, the file and the row's place in it; any
    other table is written first."""
    key = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("__row")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "parquet" not in plan.toString().lower():
        docs = cut_lineage(docs)
    return docs.select(key, whole)


def drop_keys(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of ``row_keyed`` rows without those whose key is in ``gone``'s column ``__gone``."""
    kept = rows.join(gone, F.col("__row") == F.col("__gone"), "left_anti")
    return kept.select("__doc.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
