"""Similar-trajectory search: J05 J06 J08 G03 R08 M03 and the exact top-k.

Queries are few (at most the hop-set size N); items are all trips of a split.
Items are packed once into chunks of a group (ids and a matrix); queries are
sent to the chunks in blocks of at most QUERY_BLOCK rows, and a task measures a
chunk against PIECE queries at a time as matrices. For a small k each chunk
gives its own k best. For a large one a first pass counts distances in bins per
query, and only rows up to the bin that holds rank k leave the second. So
neither the near set nor the farthest set ever shuffles all query x item pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import NEAR_EXCLUSION
from ..session import bounded_broadcast, cut_lineage, ship_package
from .ordinal import row_ordinal
from .permutation import domain, place_of, round_keys

QUERY_BLOCK = 4_096      # query rows broadcast at once
PIECE = 256              # queries measured at once
CHUNK = 2_048            # items of a chunk, fewer if their vectors are long
CHUNK_BYTES = 1 << 20
SMALL_K = 64             # up to here a chunk gives its k best, beyond it distances are counted in bins first
CROWD = 1_000_000        # rows of one query, beyond which they are ranked in two levels
SALT = 16
_BIN_BITS = 45           # a bin: all but the last 45 bits of the distance, 128 bins between powers of two
_EMPTY = "qid long, item long, dist double, rank int"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, _iv, _g) as chunks (_g, d, ids, vecs) of one group and one vector length;
    a vector with a missing value has no place in its chunk."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("_iv")))
        width = batch.column("_iv").value_lengths().to_numpy(zero_copy_only=False)
        group = np.array(batch.column("_g").to_pylist(), object)
        for g, d in {(g, d) for g, d in zip(group, width.tolist()) if g is not None}:
            rows = batch.filter(pa.array((group == g) & (width == d)))
            flat = rows.column("_iv").flatten()
            whole = ~np.asarray(flat.is_null()).reshape(rows.num_rows, d).any(axis=1)
            whole &= np.asarray(rows.column("item").is_valid())
            vecs = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, d)[whole]
            ids = rows.column("item").to_numpy(zero_copy_only=False)[whole].astype(np.int64)
            step = max(1, min(CHUNK, CHUNK_BYTES // (8 * max(d, 1))))
            for i in range(0, max(len(ids), 1), step):
                yield pa.RecordBatch.from_pydict({"_g": pa.array([g], pa.int64()), "d": pa.array([d], pa.int32()),
                                                  "ids": [ids[i:i + step].tobytes()], "vecs": [vecs[i:i + step].tobytes()]})


def _measured(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Group, query ids, cuts, item ids, distances and bins of each chunk against its queries, PIECE at a time.
    Squares are added dimension by dimension, as a SQL fold does."""
    for row in range(batch.num_rows):
        one = batch.slice(row, 1)
        d, asked = one.column("d")[0].as_py(), one.column("qs").flatten()
        qvec = asked.field("vec")
        if pc.any(pc.not_equal(qvec.value_lengths(), d)).as_py():
            raise ValueError("vectors of different length")
        items = np.frombuffer(one.column("ids")[0].as_py(), np.int64)
        flat = qvec.flatten()
        whole = ~np.asarray(flat.is_null()).reshape(len(asked), d).any(axis=1)
        q = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(asked), d)[whole]
        qids, cuts = (asked.field(c).to_numpy(zero_copy_only=False)[whole].astype(np.int64) for c in ("qid", "cut"))
        x = np.ascontiguousarray(np.frombuffer(one.column("vecs")[0].as_py(), np.float64).reshape(len(items), d).T)
        for i in range(0, len(q), PIECE) if len(items) else ():
            part = q[i:i + PIECE]
            dist, gap = np.zeros((len(part), len(items))), np.empty((len(part), len(items)))
            for j in range(d):
                np.subtract(x[j][None, :], part[:, j][:, None], out=gap)
                np.multiply(gap, gap, out=gap)
                dist += gap
            dist = np.abs(np.sqrt(dist, out=dist))                       # no sign on NaN: it is the largest
            yield one.column("_g")[0].as_py(), qids[i:i + PIECE], cuts[i:i + PIECE], items, dist, dist.view(np.int64) >> _BIN_BITS


def _rows(qids: np.ndarray, items: np.ndarray, dist: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    at, of = np.nonzero(mask)
    return pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(items[of]), pa.array(dist[at, of])], names=["qid", "item", "dist"])


def _own_best(k: int, largest: bool):
    """The k best of each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, qids, _, items, dist, _ in _measured(batch):
                order = -np.nan_to_num(dist, nan=np.inf, posinf=np.finfo(float).max) if largest else dist
                if k >= len(items):
                    mask = np.ones(dist.shape, bool)
                else:
                    mask = ~(order > np.partition(order, k - 1, axis=1)[:, k - 1][:, None])
                    for i in np.flatnonzero(mask.sum(axis=1) > k):              # ties: the lowest ids of them
                        best = np.lexsort((items, order[i]))[:k]
                        mask[i] = False
                        mask[i, best] = True
                yield _rows(qids, items, dist, mask)
    return run


def _count_bins(k: int, largest: bool):
    """(qid, bin, n) of a task's pairs; bins that lie behind the task's own first k say nothing and are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for g, qids, _, _, _, bins in _measured(batch):
                names, at = np.unique(bins, return_inverse=True) if np.ptp(bins) > 16_384 else (np.arange(bins.min(), bins.max() + 1), bins - bins.min())
                new = np.bincount((at.reshape(bins.shape) + np.arange(len(qids))[:, None] * len(names)).ravel(),
                                  minlength=len(qids) * len(names)).reshape(len(qids), len(names)).astype(np.int32)
                key = (g, qids.tobytes())
                if key in seen:
                    _, had, old = seen[key]
                    both = np.union1d(had, names)
                    total = np.zeros((len(qids), len(both)), np.int32)
                    total[:, np.searchsorted(both, had)] += old
                    total[:, np.searchsorted(both, names)] += new
                    names, new = both, total
                seen[key] = qids, names, new
        for qids, names, n in seen.values():
            names, n = (names[::-1], n[:, ::-1]) if largest else (names, n)
            at, of = np.nonzero((n > 0) & (np.cumsum(n, axis=1, dtype=np.int64) - n < k))
            yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(names[of]), pa.array(n[at, of].astype(np.int64))], names=["qid", "bin", "n"])
    return run


def _up_to_cut(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, qids, cuts, items, dist, bins in _measured(batch):
                yield _rows(qids, items, dist, bins >= cuts[:, None] if largest else bins <= cuts[:, None])
    return run


def vector_topk(queries: DataFrame, items: DataFrame, k: int, largest: bool = False,
                qvec: str = "vec", ivec: str = "vec", item: str = "item",
                group: str | None = None) -> DataFrame:
    """Exact k nearest (or farthest) items per query by Euclidean distance.

    Distances sum squared differences dimension by dimension (the same order
    as a SQL fold), ties by item id. Items and queries with a missing vector or
    value are skipped; a vector of another length is an error. With ``group``,
    a query only meets items of its own group (e.g. split). Rows beyond a
    chunk's k best, or beyond the bin of rank k, are dropped before any shuffle. Output: qid, item, dist, rank (0-based).
    """
    spark = items.sparkSession
    if k <= 0:
        return spark.createDataFrame([], _EMPTY)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))           # chunks are large rows
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    qs = queries.select(F.col("qid").cast("long").alias("qid"), doubles(qvec).alias("vec"), g.alias("_g")).where("qid IS NOT NULL AND vec IS NOT NULL")
    its = items.select(F.col(item).cast("long").alias("item"), doubles(ivec).alias("_iv"), g.alias("_g"))
    n = qs.count()
    if n == 0:
        return spark.createDataFrame([], _EMPTY)
    # More chunks than cores, dealt evenly: each costs the same.
    chunks = cut_lineage(its.mapInArrow(_pack, "_g long, d int, ids binary, vecs binary").repartition(3 * spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-n // (QUERY_BLOCK // 2)))
    return reduce(DataFrame.unionByName, [
        _block_topk(qs.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else qs, chunks, k, largest)
        for b in range(blocks)])


def _block_topk(qs: DataFrame, chunks: DataFrame, k: int, largest: bool) -> DataFrame:
    # A block of queries: a bounded number of rows, a row a group, so it may be sent to every task.
    def asked(q: DataFrame) -> DataFrame:
        return chunks.join(F.broadcast(q.groupBy("_g").agg(F.collect_list(F.struct("qid", "vec", "cut")).alias("qs"))), "_g").select("_g", "d", "ids", "vecs", "qs")

    pairs = "qid long, item long, dist double"
    salted = False
    if k <= SMALL_K:
        kept = asked(qs.withColumn("cut", F.lit(0).cast("long"))).mapInArrow(_own_best(k, largest), pairs)
    else:
        counts = asked(qs.withColumn("cut", F.lit(0).cast("long"))).mapInArrow(_count_bins(k, largest), "qid long, bin long, n long")
        nearer = F.col("bin").desc() if largest else F.col("bin").asc()
        upto = Window.partitionBy("qid").orderBy(nearer).rowsBetween(Window.unboundedPreceding, 0)
        need = cut_lineage(counts.groupBy("qid", "bin").agg(F.sum("n").alias("n")).withColumn("_upto", F.sum("n").over(upto))
                           .where(F.col("_upto") - F.col("n") < k)
                           .groupBy("qid").agg((F.min if largest else F.max)("bin").alias("cut"), F.max("_upto").alias("_upto")))
        salted = (need.agg(F.max("_upto")).first()[0] or 0) > max(CROWD, 2 * k)
        kept = asked(qs.join(F.broadcast(need.select("qid", "cut")), "qid")).mapInArrow(_up_to_cut(largest), pairs)
    order = (F.col("dist").desc() if largest else F.col("dist").asc(), F.col("item").asc())
    if salted:      # many equal distances share the last bin: two levels, so no group holds them all
        w0 = Window.partitionBy("qid", "_salt").orderBy(*order)
        kept = kept.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(SALT))).withColumn("_r0", F.row_number().over(w0)).where(F.col("_r0") <= k)
    w = Window.partitionBy("qid").orderBy(*order)
    return kept.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < k).select("qid", "item", "dist", "rank")


def nearest_set(queries: DataFrame, items: DataFrame, near: int = NEAR_EXCLUSION,
                group: str | None = None) -> DataFrame:
    """The ``near`` nearest items of each query (itself included)."""
    return vector_topk(queries, items, near, group=group).select("qid", "item")


def seeded_hash(seed: int, *cols) -> Column:
    """A hash that any SQL engine can compute: md5 of the seed and the values."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_negatives(queries: DataFrame, items: DataFrame, m: int, seed: int = 0,
                     near: int = NEAR_EXCLUSION, mode: str = "uniform",
                     group: str | None = None) -> DataFrame:
    """G03 + R08: M negatives per query, never one of its ``near`` nearest.

    ``mode="uniform"`` (the reference's meaning, seeded): the items of a group
    have places by their id, and each query goes through the places in an order
    of its own, a permutation keyed by the seed and the query; it takes the
    first M without its near set. So queries draw independently, and a query
    meets M + near items (and fewer than the square root of the group's) by an
    equi-join on places, not the whole group. ``mode="farthest"``: the M
    farthest (ties by item id). A group with at most ``near`` items uses its M
    farthest, in the query's order. M is capped per
    group at (items - queries). With ``group`` (e.g. split) queries only draw
    from their own group; every group is one pass.
    Output: qid, item, neg_idx (1..M), in the order the negatives are listed.
    """
    gq = F.col(group).cast("long") if group else F.lit(0).cast("long")
    q = queries.select("qid", "vec", gq.alias("_g"))
    it = items.select(F.col("item").cast("long").alias("item"), "vec", gq.alias("_g"))
    # One row per group.
    sizes = (it.groupBy("_g").agg(F.count(F.lit(1)).alias("_t"))
             .join(q.groupBy("_g").agg(F.count(F.lit(1)).alias("_nq")), "_g")
             .select("_g", "_t", F.greatest(F.lit(0), F.least(F.col("_t") - F.col("_nq"), F.lit(m))).alias("_m")))
    qs = q.select("qid", "_g").join(sizes, "_g")
    near_set = bounded_broadcast(cut_lineage(nearest_set(q, it, near, group="_g")))       # at most ``near`` rows a query
    idx = lambda *order: F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("int")
    if mode == "farthest":
        qs = bounded_broadcast(cut_lineage(qs))             # a row a query; the order of the far rows stays
        far = vector_topk(q, it, m + near, largest=True, group="_g").join(qs, "qid")
        far = far.join(near_set.join(qs.where(F.col("_t") > near).select("qid"), "qid", "left_semi"), ["qid", "item"], "left_anti")
        return far.withColumn("neg_idx", idx(F.col("dist").desc(), "item")).where(F.col("neg_idx") <= F.col("_m")).select("qid", "item", "neg_idx")
    placed = row_ordinal(it.select("item", "_g"), ["item"], name="_place", group="_g")
    reach = F.least(F.col("_t"), F.col("_m") + near) + domain(F.col("_t")) - F.col("_t")
    walked = (qs.where(F.col("_m") > 0).withColumn("_keys", round_keys(seed, "qid"))
              .withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), reach - 1))))
    taken = (walked.withColumn("_place", place_of("_step", "_t", "_keys")).where(F.col("_place") < F.col("_t")).drop("_keys")
             .join(placed.select("_g", "_place", "item"), ["_g", "_place"]))
    big = taken.where(F.col("_t") > near).join(near_set, ["qid", "item"], "left_anti")
    big = big.withColumn("neg_idx", idx("_step")).where(F.col("neg_idx") <= F.col("_m"))
    small_far = vector_topk(q, it, near, largest=True, group="_g").join(qs.where(F.col("_t") <= near), "qid").where(F.col("rank") < F.col("_m"))
    small = taken.join(small_far.select("qid", "item"), ["qid", "item"], "left_semi").withColumn("neg_idx", idx("_step"))
    return big.select("qid", "item", "neg_idx").unionByName(small.select("qid", "item", "neg_idx"))
