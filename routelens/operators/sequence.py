"""Sequence operators: R01 R02 R04-R06 A07 W06 G05 A13.

Trips arrive in long form (one row per point with ``pos`` and ``n``); arrays are
built only after the length filter, so no array grows beyond 120 points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import KSEG


def trip_sequences(points: DataFrame, cols: list[str], keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """One row per trip with its points in order as an array of structs."""
    s = F.array_sort(F.collect_list(F.struct("pos", *cols)))
    return (points.groupBy(*keys).agg(s.alias("_pts"))
            .select(*keys, F.transform("_pts", lambda p: p.dropFields("pos")).alias("points"),
                    F.size("_pts").alias("length")))


def hop_split(points: DataFrame) -> DataFrame:
    """Even positions form the query, odd positions the target."""
    return (points.withColumn("role", F.when(F.col("pos") % 2 == 0, F.lit("qry")).otherwise(F.lit("tgt")))
            .withColumn("sub_pos", F.floor(F.col("pos") / 2).cast("int")))


def flatten_valid(seqs: DataFrame, arr: str, valid_len: str, keys: list[str]) -> DataFrame:
    """One row per valid element (pack_padded_sequence)."""
    return seqs.select(*keys, F.posexplode(F.slice(arr, 1, F.col(valid_len).cast("int"))).alias("pos", "value"))


def first_n_trips(valid: DataFrame, n: int, key: str = "trip") -> DataFrame:
    """Per split, the first min(len - 1, n) trips in ascending id, with index.

    Each split is a bounded top-n (TakeOrderedAndProject keeps n rows per task).
    """
    sizes = {r["split"]: r["cnt"] for r in valid.groupBy("split").agg(F.count(F.lit(1)).alias("cnt")).collect()}
    parts = []
    for s, cnt in sorted(sizes.items()):
        m = min(cnt - 1, n)
        if m <= 0:
            continue
        parts.append(valid.where(F.col("split") == s).orderBy(key).limit(m))
    if not parts:
        return valid.limit(0).withColumn("idx", F.lit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Window over at most n rows per split.
    return out.withColumn("idx", (F.row_number().over(Window.partitionBy("split").orderBy(key)) - 1).cast("int"))


def _kseg_table(points: DataFrame, cols: list[str], k: int, keys: tuple[str, ...]) -> DataFrame:
    """keys + ``_s``: per-trip array of k structs (seg, means), NULL means for
    empty segments. Means are a grouped aggregate on (trip, seg) (map-side
    combined); the second grouping holds at most k rows per trip."""
    seg_len = F.floor(F.col("n") / k)
    seg = F.when(seg_len == 0, F.lit(k - 1)).otherwise(
        F.least(F.floor(F.col("pos") / seg_len), F.lit(k - 1))).cast("int")
    g = points.withColumn("seg", seg).groupBy(*keys, "seg").agg(*[F.avg(c).alias(c) for c in cols])
    per = g.groupBy(*keys).agg(F.collect_list(F.struct("seg", *cols)).alias("_segs"))
    full = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.struct(i.alias("seg"), *[
            F.try_element_at(F.filter("_segs", lambda x: x["seg"] == i), F.lit(1))[c].alias(c) for c in cols]))
    return per.select(*keys, full.alias("_s"))


def kseg_long(points: DataFrame, cols: list[str], k: int = KSEG, keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """A07 in long form: mean of each column over k segments of each trip.

    seg = n div k; segment i < k-1 covers [i seg, (i+1) seg); the last one takes
    the rest. A trip shorter than k leaves the first segments empty (NULL).
    """
    t = _kseg_table(points, cols, k, keys)
    return t.select(*keys, F.inline("_s"))


def kseg_vectors(points: DataFrame, cols: list[str], k: int = KSEG, keys: tuple[str, ...] = ("trip",)) -> DataFrame:
    """The k-segment vector (segment-major, k * len(cols) values)."""
    t = _kseg_table(points, cols, k, keys)
    return t.select(*keys, F.flatten(F.transform("_s", lambda r: F.array(*[r[c] for c in cols]))).alias("vec"))


def kseg_array(pts: str, cols: list[str], k: int = KSEG) -> Column:
    """A07 on a row that holds its trip as an array: k structs (seg, means)."""
    n = F.size(pts)
    size = F.floor(n / k)

    def segment(i):
        first = F.when(size == 0, F.when(i == k - 1, F.lit(0))).otherwise(i * size)
        count = F.when(size == 0, n).when(i == k - 1, n - (k - 1) * size).otherwise(size)
        own = F.slice(pts, (first + 1).cast("int"), count.cast("int"))
        mean = lambda c: F.aggregate(F.filter(own, lambda p: p[c].isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                                     lambda a, p: F.struct((a["s"] + p[c]).alias("s"), (a["n"] + 1).alias("n")),
                                     lambda a: F.try_divide(a["s"], a["n"].cast("double")))
        return F.struct(i.cast("int").alias("seg"), *[mean(c).alias(c) for c in cols])

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), segment)


def kseg_vector(pts: str, cols: list[str], k: int = KSEG) -> Column:
    """A07 on a row's array: the k-segment vector (segment-major, k * len(cols) values)."""
    return F.flatten(F.transform(kseg_array(pts, cols, k), lambda r: F.array(*[r[c] for c in cols])))


def extrapolate_trip(points: DataFrame, pre_length: int, step_unit: str = "second") -> DataFrame:
    """Momentum extrapolation of the cut trip end by ``pre_length`` steps.

    The trip is first cut to its first n-1-pre points; with a = the last and
    b = the one before, step i gives lng_a + i (lng_a - lng_b) / gap (Q4:
    degrees per second), seconds_a + i gap. ``step_unit="gap"`` multiplies by
    the gap instead. A zero gap gives NULL places.
    """
    cut = F.col("n") - 1 - pre_length
    ab = (points.where((F.col("pos") == cut - 1) | (F.col("pos") == cut - 2))
          .groupBy("trip").agg(F.max_by(F.struct("lng", "lat", "seconds"), "pos").alias("a"),
                               F.min_by(F.struct("lng", "lat", "seconds"), "pos").alias("b"),
                               F.count(F.lit(1)).alias("_c"))
          .where("_c = 2"))
    gap = F.col("a.seconds") - F.col("b.seconds")
    steps = ab.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(max(pre_length, 1)))))
    if step_unit == "gap":
        f = F.col("step")
    else:
        f = F.try_divide(F.col("step").cast("double"), gap)
    out = steps.select(
        "trip", "step",
        (F.col("a.lng") + f * (F.col("a.lng") - F.col("b.lng"))).alias("lng"),
        (F.col("a.lat") + f * (F.col("a.lat") - F.col("b.lat"))).alias("lat"),
        (F.col("a.seconds") + F.col("step") * gap).alias("seconds"))
    return out if pre_length >= 1 else out.limit(0)


def mean_pool(vectors: DataFrame, vec: str, keys: list[str], mask_len: str | None = None) -> DataFrame:
    """Mean of vectors per key, element-wise; optional valid-length mask.

    Exploded to (key, i, value) and averaged with a grouped aggregate, so a
    large group is combined map-side. Divisor floor 1e-9 as in the reference.
    """
    src = vectors
    if mask_len is not None:
        src = src.withColumn(vec, F.slice(vec, 1, F.col(mask_len).cast("int")))
    ex = src.select(*keys, F.posexplode(vec).alias("i", "value"))
    return ex.groupBy(*keys, "i").agg(
        (F.sum("value") / F.greatest(F.count("value").cast("double"), F.lit(1e-9))).alias("value"))
