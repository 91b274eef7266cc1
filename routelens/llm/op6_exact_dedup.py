"""Operator 6: exact duplicates by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text (A-Z in lower
case): first by length and the first bytes, then by further runs of bytes,
each run GROWTH times as long as all before it. A group leaves when it is a
single row or its text has ended; then its rows are equal byte for byte, so no
digest is needed. Each round counts the groups with partial sums before the
shuffle and joins the counts back, so that a group of copies of any size is
spread over tasks (adaptive joins split it). Only rows of open groups, with
the bytes still to be compared, are written for the next round.

Null and empty texts are equal to one another. Of equal rows the largest
``doc_id`` stays; rows repeated with that same id all say ``kept``; a null id
is smaller than any other, and stays only where a group has null ids alone.
Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, drop_keys, prepare, row_keyed, slices, union_all, utf8_of

FIRST_BYTES = 64
GROWTH = 16


def _digits(docs: DataFrame, id_col: str, text_col: str, first: int, rest: bool) -> DataFrame:
    """(id, sha, n, digit[, rest]): length, first bytes and (if asked for) later bytes of each normalised text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [b.lower() for b in utf8_of(part.column("text"))]       # bytes.lower() changes A-Z only
                more = [pa.array([t[first:] for t in texts], pa.binary())] if rest else []
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                     pa.array(map(len, texts), pa.int64()), pa.array([t[:first] for t in texts], pa.binary()), *more],
                    names=["id", "sha", "n", "digit", "rest"][:4 + rest])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, sha string, n long, digit binary" + ", rest binary" * rest))


def _groups(rows: DataFrame, keys: list[str], upto: int) -> DataFrame:
    """Size and largest id of each group, a number for it, and whether its rows still have to be split."""
    g = rows.groupBy(*keys, *(["n"] if "n" not in keys else [])).agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("top"))
    return cut_lineage(g.withColumn("open", (F.col("size") > 1) & (F.col("n") > upto))
                       .withColumn("number", F.monotonically_increasing_id()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``)."""
    prepare(docs.sparkSession)
    seen = FIRST_BYTES
    rows = cut_lineage(_digits(docs, id_col, text_col, seen, rest=False))
    groups = _groups(rows, ["n", "digit"], seen)
    done = [rows.join(groups.where(~F.col("open")), ["n", "digit"]).select("id", "sha", "top", "size")]
    if not groups.where("open").isEmpty():
        opened = groups.where("open").select("n", "digit", F.col("number").alias("group"))
        rows = cut_lineage(_digits(docs, id_col, text_col, seen, rest=True).join(opened, ["n", "digit"])
                           .select("group", "id", "sha", "n", "rest"))
        while True:
            run = seen * (GROWTH - 1)
            seen += run
            digit = F.substring("rest", 1, run)
            groups = _groups(rows.withColumn("digit", digit), ["group", "digit"], seen)
            split = rows.withColumn("digit", digit).join(groups.drop("n"), ["group", "digit"])
            if groups.where("open").isEmpty():
                done.append(split.select("id", "sha", "top", "size"))
                break
            later = F.when(F.col("open"), F.expr(f"substring(rest, {run + 1})"))
            split = cut_lineage(split.select(F.col("number").alias("group"), "id", "sha", "n", "top", "size", "open", later.alias("rest")))
            done.append(split.where(~F.col("open")).select("id", "sha", "top", "size"))
            rows = split.where("open").select("group", "id", "sha", "n", "rest")
    return union_all(done).select(
        F.col("id").alias(id_col), F.col("top").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("top")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the
    largest id. Rows go by their own key, so repeated and null ids don't matter."""
    rows = row_keyed(docs)
    named = rows.select(F.struct(F.col(f"__doc.{id_col}").alias("id"), F.col("__row").alias("row")).alias("id"), F.col(f"__doc.{text_col}").alias("text"))
    gone = exact_dedup(named, "id", "text").where(~F.col("kept")).select(F.col("id.row").alias("__gone"))
    return drop_keys(rows, gone)
