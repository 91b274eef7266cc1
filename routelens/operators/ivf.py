"""Approximate nearest neighbours by an inverted file.

A coarse quantiser (k-means centroids, fitted on a bounded sample) deals every
vector to the list of its nearest centroid. What is stored and shuffled of a
vector is its code: the difference from the centroid in whole steps of one byte
a dimension. A query probes the lists of its nearest centroids, ranks their
codes, and only for its best candidates are the vectors fetched, by an
equi-join, and ranked by exact distance. How many lists are probed is measured:
so many that a sample's exact neighbours are found (``tuned_probes``).

Lists longer than ``list_rows`` are split into parts, and the queries of a list
into parts of ``query_rows``; a task holds one part of each, so a crowded place
(or one vector that a third of all rows share) is many tasks of bounded size.
The centroids are bounded by ``lists`` and go to the tasks as a constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import l2_distance
from ..session import cut_lineage
from .search import vector_topk

#: Rows that the quantiser is fitted on, at most, and lists, at most.
SAMPLE, LISTS = 50_000, 4_096
#: Queries that the number of probes is measured on.
TUNING = 100
#: Queries whose distances to a part of a list are computed at once.
BLOCK = 256


class InvertedFile(NamedTuple):
    """``codes``: (list, item, code) of every item with a vector; ``step``: what one unit of a code means in each dimension."""

    codes: DataFrame
    centroids: np.ndarray
    step: np.ndarray


def default_lists(n: int) -> int:
    """The square root of the number of vectors, within 1 and ``LISTS``."""
    return int(min(LISTS, max(1, n ** 0.5)))


def _nearest(vectors: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest centroids of each vector, nearest first; equal ones by number."""
    far = (centroids * centroids).sum(1)[None, :] - 2 * vectors @ centroids.T
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def build_index(items: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> InvertedFile:
    """Fit on the ``sample`` vectors of the least hash of their id, and index all.
    Items whose vector is NULL or has a NULL or NaN aren't indexed; a vector of
    another length is an error."""
    spark = items.sparkSession
    whole = items.select(F.col("item").cast("long").alias("item"), F.transform("vec", lambda x: x.cast("double")).alias("vec")).where(
        F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
    drawn = cut_lineage(whole.orderBy(F.xxhash64("item"), "item").limit(sample))
    n = drawn.count()
    if not n:
        return InvertedFile(spark.createDataFrame([], "list int, item long, code binary"), np.zeros((0, 0)), np.zeros(0))
    lengths = drawn.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if lengths["least"] != lengths["most"]:
        raise ValueError("vectors of different length")
    model = KMeans(k=max(2, lists or default_lists(whole.count())), seed=seed, maxIter=10, featuresCol="features").fit(drawn.select(array_to_vector("vec").alias("features")))
    centroids = np.array(model.clusterCenters())
    # The widest difference of the sample sets the step of each dimension; wider ones of other rows are clipped in the code alone.
    width = drawn.select("vec").mapInPandas(_widths(centroids), "at int, wide double").groupBy("at").agg(F.max("wide").alias("wide"))
    wide = np.zeros(centroids.shape[1])
    for r in width.collect():                                   # one row a dimension
        wide[r["at"]] = r["wide"]
    step = np.where(wide > 0, wide / 127, 1.0)
    return InvertedFile(cut_lineage(whole.mapInPandas(_encode(centroids, step), "list int, item long, code binary")), centroids, step)


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = [np.asarray(v, np.float64) for v in vectors]
    if any(len(v) != dims for v in out):
        raise ValueError("vectors of different length")
    return np.stack(out)


def _widths(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["vec"], centroids.shape[1])
                wide = np.abs(x - centroids[_nearest(x, centroids, 1)[:, 0]]).max(0)
                yield pd.DataFrame({"at": np.arange(len(wide), dtype=np.int32), "wide": wide})
    return run


def _encode(centroids: np.ndarray, step: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["vec"], centroids.shape[1])
                to = _nearest(x, centroids, 1)[:, 0]
                codes = np.clip(np.rint((x - centroids[to]) / step), -127, 127).astype(np.int8)
                yield pd.DataFrame({"list": to.astype(np.int32), "item": pdf["item"].to_numpy(), "code": [c.tobytes() for c in codes]})
    return run


def _probe(centroids: np.ndarray, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                to = _nearest(_matrix(pdf["vec"], centroids.shape[1]), centroids, probes)
                pdf = pdf.loc[pdf.index.repeat(to.shape[1])]
                yield pdf.assign(list=to.ravel().astype(np.int32))
    return run


def _scan(centroids: np.ndarray, step: np.ndarray, keep: int):
    """The ``keep`` best codes of a part of a list for each query of a part."""
    def run(key: tuple, codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": np.zeros(0, np.int64), "item": np.zeros(0, np.int64), "near": np.zeros(0)})]
        if len(codes) and len(queries):
            x = np.frombuffer(b"".join(codes["code"]), np.int8).reshape(len(codes), -1).astype(np.float32) * step.astype(np.float32)
            items, own = codes["item"].to_numpy(), (x * x).sum(1)
            order = np.argsort(items, kind="stable")                       # equal distances by item
            x, items, own = x[order], items[order], own[order]
            q = (_matrix(queries["vec"], centroids.shape[1]) - centroids[key[0]]).astype(np.float32)
            ids, most = queries["qid"].to_numpy(), min(keep, len(items))
            for i in range(0, len(q), BLOCK):
                part = q[i:i + BLOCK]
                far = own[None, :] - 2 * part @ x.T + (part * part).sum(1)[:, None]
                best = np.argsort(far, axis=1, kind="stable")[:, :most]
                out.append(pd.DataFrame({"qid": np.repeat(ids[i:i + BLOCK], most), "item": items[best].ravel(),
                                         "near": np.take_along_axis(far, best, 1).ravel().astype(np.float64)}))
        return pd.concat(out)
    return run


def tuned_probes(items: DataFrame, index: InvertedFile, k: int, target: float = 0.95, sample: int = TUNING) -> int:
    """How many lists a query has to probe so that ``target`` of the exact ``k``
    nearest of ``sample`` items (of the least salted hash of their id) lie in
    them. One exact pass over all items for these few queries; it reads back
    ``sample * k`` ids at most."""
    drawn = items.select(F.col("item").cast("long").alias("qid"), F.transform("vec", lambda x: x.cast("double")).alias("vec")).join(
        index.codes.select(F.col("item").alias("qid")), "qid", "left_semi").orderBy(F.xxhash64(F.lit(7), "qid"), "qid").limit(sample)
    qs = cut_lineage(drawn)
    places = vector_topk(qs, items.select("item", F.transform("vec", lambda x: x.cast("double")).alias("vec")), k).join(index.codes.select("item", "list"), "item").select("qid", "list").collect()
    order = {r["qid"]: np.argsort(_nearest(np.array([r["vec"]]), index.centroids, len(index.centroids))[0]) for r in qs.collect()}
    ranks = sorted(int(order[r["qid"]][r["list"]]) + 1 for r in places)
    return ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))] if ranks else 1


def ann_topk(queries: DataFrame, items: DataFrame, k: int, probes: int | None = None, refine: int = 4, lists: int | None = None,
             index: InvertedFile | None = None, list_rows: int = 20_000, query_rows: int = 20_000) -> DataFrame:
    """(qid, item, rank, dist): about the ``k`` nearest items of each query (qid,
    vec), in ``probes`` lists (``tuned_probes`` if None); ``refine * k`` candidates by code are ranked by exact distance, ties by
    item. Queries without a whole vector have no rows."""
    spark = items.sparkSession
    index = index or build_index(items, lists)
    if not len(index.centroids):
        return spark.createDataFrame([], "qid long, item long, rank int, dist double")
    probes = probes or tuned_probes(items, index, k)
    qs = queries.select(F.col("qid").cast("long").alias("qid"), F.transform("vec", lambda x: x.cast("double")).alias("vec")).where(
        F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
    probed = cut_lineage(qs.mapInPandas(_probe(index.centroids, probes), "qid long, vec array<double>, list int"))
    parts = lambda n, rows: F.ceil(F.coalesce(F.col(n), F.lit(0)) / rows).cast("int")
    # One row a list.
    sizes = cut_lineage(index.codes.groupBy("list").agg(F.count(F.lit(1)).alias("ni")).join(probed.groupBy("list").agg(F.count(F.lit(1)).alias("nq")), "list")
                        .select("list", parts("ni", list_rows).alias("ip"), parts("nq", query_rows).alias("qp")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    codes = index.codes.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("item"), F.col("ip")).cast("int").alias("ipart"), every("qp").alias("qpart"), "item", "code")
    asked = probed.join(F.broadcast(sizes), "list").select(
        F.col("list").alias("of"), F.pmod(F.xxhash64("qid"), F.col("qp")).cast("int").alias("qat"), every("ip").alias("iat"), "qid", "vec")
    found = codes.groupBy("list", "ipart", "qpart").cogroup(asked.groupBy("of", "iat", "qat")).applyInPandas(
        _scan(index.centroids, index.step, k * refine), "qid long, item long, near double")
    by_query = Window.partitionBy("qid")
    # Candidates of a query: at most k * refine from each part that it probed.
    best = found.withColumn("r", F.row_number().over(by_query.orderBy("near", "item"))).where(F.col("r") <= k * refine).select("qid", "item")
    vectors = items.select(F.col("item").cast("long").alias("item"), F.transform("vec", lambda x: x.cast("double")).alias("ivec"))
    exact = best.join(vectors, "item").join(qs, "qid").select("qid", "item", l2_distance("vec", "ivec").alias("dist"))
    return exact.withColumn("rank", (F.row_number().over(by_query.orderBy("dist", "item")) - 1).cast("int")).where(F.col("rank") < k).select("qid", "item", "rank", "dist")
