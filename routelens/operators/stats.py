"""Statistics and scaling: A01-A06, P07-P12, J02.

Statistics are one-row (or one-row-per-column) results of grouped aggregates;
they are joined back with ``broadcast`` because their size is fixed by the
number of columns, never by the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinal import row_ordinal

DESCRIBE_STATS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def _stack(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long form (column, value, _tie) of numeric columns, NULLs dropped.

    ``_tie`` is a deterministic hash of the whole source row and the column,
    so repeated values spread over range partitions and re-execution after a
    lost task sees the same order.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                      for c in cols])
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns])
    return (df.select(row_hash.alias("_rh"), F.explode(pairs).alias("_p"))
            .select("_p.column", "_p.value", F.xxhash64("_rh", "_p.column").alias("_tie"))
            .where(F.col("value").isNotNull()))


def _values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long form (column, value) of numeric columns, NULLs dropped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("_p")).select("_p.column", "_p.value").where(F.col("value").isNotNull())


def exact_order_stats(long: DataFrame | Callable[[list[str]], DataFrame], targets: dict[tuple[str, int], tuple[float, float]],
                      buckets: int = 1024, window: int = 20_000) -> dict:
    """Exact k-th smallest values of (column, value) rows by iterative selection.

    ``long`` is a frame or, for a list of columns, gives one. ``targets`` maps
    (column, rank) to the column's (min, max). Each pass is
    one scan with a map-side-combined histogram of ``buckets`` bins over the
    current value window of every target (a few thousand tiny rows are read
    back); the window shrinks to the bin holding the rank. A window of at most
    ``window`` values (or of one repeated value) is read back and the value
    picked. Each pass narrows the window at least to the values of one bin, so
    columns of any range end. No data is shuffled or sorted.
    """
    of = long if callable(long) else lambda cols: long
    state = {t: (lo, hi, 0) for t, (lo, hi) in targets.items()}   # lo, hi, rows below lo
    result: dict = {}
    while True:
        open_t = {t: v for t, v in state.items() if t not in result}
        if not open_t:
            break
        small, wide = {}, {}
        for t, (lo, hi, below) in open_t.items():
            (small if lo == hi else wide)[t] = (lo, hi, below)
        for t, (lo, _, _) in small.items():
            result[t] = lo
        if not wide:
            break
        own = of(sorted({c for c, _ in wide}))              # the columns still open
        spark = own.sparkSession
        win = spark.createDataFrame([(c, r, lo, hi, below) for (c, r), (lo, hi, below) in wide.items()],
                                    "column string, _k long, _lo double, _hi double, _below long")
        inwin = (own.join(F.broadcast(win), "column")
                 .where((F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))))
        # halves, so that the widest range of doubles doesn't overflow
        share = F.try_divide(F.col("value") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        b = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 1))
        hist = (inwin.groupBy("column", "_k", b.alias("_b"))
                .agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_mn"), F.max("value").alias("_mx"))
                .collect())
        per: dict = {}
        for r in hist:
            per.setdefault((r["column"], r["_k"]), []).append((r["_b"], r["_n"], r["_mn"], r["_mx"]))
        fetch = {}
        for t, (lo, hi, below) in wide.items():
            cum = below
            for _b, n, mn, mx in sorted(per.get(t, [])):
                if cum + n > t[1]:
                    if mn != mx and (n <= window or (mn, mx) == (lo, hi)):
                        fetch[t] = (mn, mx, cum)
                    state[t] = (mn, mx, cum)
                    break
                cum += n
        if fetch:
            win = spark.createDataFrame([(c, r, lo, hi) for (c, r), (lo, hi, _) in fetch.items()],
                                        "column string, _k long, _lo double, _hi double")
            vals = (own.join(F.broadcast(win), "column")
                    .where((F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi")))
                    .select("column", "_k", "value").collect())
            got: dict = {}
            for r in vals:
                got.setdefault((r["column"], r["_k"]), []).append(r["value"])
            for t, (_, _, below) in fetch.items():
                result[t] = sorted(got[t])[t[1] - below]
    return result


def describe(df: DataFrame, cols: list[str], quantiles: str = "exact") -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear), max per column.

    One row per column. ``quantiles="exact"`` finds the needed order
    statistics by iterative selection (``exact_order_stats``: scans and tiny
    histograms, no sort); ``"sort"`` ranks all values with a distributed sort
    (G06); ``"approx"`` uses ``percentile_approx`` (no interpolation).
    """
    # Every pass re-reads ``df``: pass a written table (column-pruned scans).
    # One wide aggregate for count, mean and bounds, one for the deviations from
    # the mean (stable for large magnitudes such as epoch seconds).
    num = {c: F.col(c).cast("double") for c in cols}
    wide = df.agg(*[f(num[c]).alias(f"{i}_{k}") for i, c in enumerate(cols)
                    for k, f in (("count", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))]).first()
    rows = [{"column": c, **{k: wide[f"{i}_{k}"] for k in ("count", "mean", "min", "max")}} for i, c in enumerate(cols)]
    rows = [r for r in rows if r["count"]]
    dev = df.agg(F.lit(0), *[F.sum((num[r["column"]] - F.lit(r["mean"])) * (num[r["column"]] - F.lit(r["mean"]))) for r in rows]).first()
    base = df.sparkSession.createDataFrame(
        [(r["column"], r["count"], r["mean"], r["min"], r["max"], math.sqrt(ss / (r["count"] - 1)) if r["count"] > 1 else None)
         for r, ss in zip(rows, dev[1:], strict=True)],
        "column string, count long, mean double, min double, max double, std double")
    qs = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
    if quantiles == "approx":
        q = _stack(df, cols).groupBy("column").agg(
            F.percentile_approx("value", [0.25, 0.5, 0.75], 10000).alias("_q"))
        q = q.select("column", *[F.col("_q")[i].alias(n) for i, n in enumerate(["p25", "p50", "p75"])])
        return base.join(q, "column")
    if quantiles == "exact" and any(not (math.isfinite(r["min"]) and math.isfinite(r["max"])) for r in rows):
        quantiles = "sort"                        # bins need finite bounds
    if quantiles == "exact":
        targets, plan = {}, []
        for r in rows:
            n = r["count"]
            if not n:
                continue
            for name, q in qs:
                h = (n - 1) * q
                lo_r, hi_r = int(math.floor(h)), int(math.ceil(h))
                targets[(r["column"], lo_r)] = (r["min"], r["max"])
                targets[(r["column"], hi_r)] = (r["min"], r["max"])
                plan.append((r["column"], name, lo_r, hi_r, h - math.floor(h)))
        vals = exact_order_stats(lambda open_cols: _values(df, open_cols), targets)
        qrows = {}
        for c, name, lo_r, hi_r, frac in plan:
            v_lo, v_hi = vals[(c, lo_r)], vals[(c, hi_r)]
            qrows.setdefault(c, {})[name] = v_lo + (v_hi - v_lo) * frac
        qdf = df.sparkSession.createDataFrame(
            [(c, d.get("p25"), d.get("p50"), d.get("p75")) for c, d in qrows.items()],
            "column string, p25 double, p50 double, p75 double")
        return base.join(F.broadcast(qdf), "column", "left")
    # "sort": rank every value (range-partitioned sort, no single partition).
    ranked = row_ordinal(_stack(df, cols), ["value", "_tie"], name="_rank", group="column", few_groups=True)
    wanted = []
    for name, q in qs:
        h = (F.col("count") - 1) * F.lit(q)
        wanted.append(base.select("column", F.lit(name).alias("_q"), F.floor(h).alias("_lo"),
                                  F.ceil(h).alias("_hi"), (h - F.floor(h)).alias("_frac")))
    wanted = reduce(DataFrame.unionByName, wanted)           # 3 rows per column
    need = (wanted.select("column", F.explode(F.array("_lo", "_hi")).alias("_rank")).distinct())
    picked = ranked.join(F.broadcast(need), ["column", "_rank"]).select("column", "_rank", "value")
    lo = picked.withColumnRenamed("_rank", "_lo").withColumnRenamed("value", "_vlo")
    hi = picked.withColumnRenamed("_rank", "_hi").withColumnRenamed("value", "_vhi")
    qv = (wanted.join(lo, ["column", "_lo"]).join(hi, ["column", "_hi"])
          .select("column", "_q", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("v")))
    qw = qv.groupBy("column").pivot("_q", ["p25", "p50", "p75"]).agg(F.first("v"))
    return base.join(qw, "column", "left")


def minmax_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with min_<c> and max_<c> for each column."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*aggs)


def zscore_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    return df.agg(*aggs)


def normalize_minmax(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min) * 2 - 1; a zero span gives NULL (try_divide)."""
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(c, F.try_divide(F.col(c) - F.col(f"min_{c}"),
                                             F.col(f"max_{c}") - F.col(f"min_{c}")) * 2 - 1)
    return out.drop(*stats.columns)


def normalize_zscore(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """P10: (x - mean) / sample std."""
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(c, F.try_divide(F.col(c) - F.col(f"mean_{c}"), F.col(f"std_{c}")))
    return out.drop(*stats.columns)


def denormalize(df: DataFrame, stats: DataFrame, cols: list[str], kind: str = "minmax") -> DataFrame:
    """Inverse of P09/P10 for the requested columns only."""
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        if kind == "minmax":
            v = (F.col(c) + 1) / 2 * (F.col(f"max_{c}") - F.col(f"min_{c}")) + F.col(f"min_{c}")
        else:
            v = F.col(c) * F.col(f"std_{c}") + F.col(f"mean_{c}")
        out = out.withColumn(c, v)
    return out.drop(*stats.columns)


def scale_unit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Whole-table min-max to [0, 1] over all listed columns together."""
    lo = F.least(*[F.min(c) for c in cols]) if len(cols) > 1 else F.min(cols[0])
    hi = F.greatest(*[F.max(c) for c in cols]) if len(cols) > 1 else F.max(cols[0])
    st = df.agg(lo.alias("_lo"), hi.alias("_hi"))
    out = df.crossJoin(F.broadcast(st))
    for c in cols:
        out = out.withColumn(c, F.try_divide(F.col(c) - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return out.drop("_lo", "_hi")


def fill_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN and NULL to 0, +-inf to +-max double (numpy's nan_to_num)."""
    big = 1.7976931348623157e308
    out = df
    for c in cols:
        x = F.col(c).cast("double")
        out = out.withColumn(c, F.when(x.isNull() | F.isnan(x), F.lit(0.0))
                             .when(x == float("inf"), F.lit(big))
                             .when(x == float("-inf"), F.lit(-big)).otherwise(x))
    return out


def cardinalities(road_info: DataFrame, trip_info: DataFrame, class_col: str = "driver") -> DataFrame:
    """num_road = max(road)+1, num_class = max(driver)+1."""
    r = road_info.agg((F.max("road") + 1).cast("long").alias("num_road"))
    c = trip_info.agg((F.max(class_col) + 1).cast("long").alias("num_class"))
    return r.crossJoin(c)


def trip_counts(trip_info: DataFrame, points: DataFrame) -> DataFrame:
    """Trips listed, distinct trips with points."""
    a = trip_info.agg(F.count(F.lit(1)).alias("num_trips"))
    b = points.agg(F.countDistinct("trip").alias("distinct_trips"))
    return a.crossJoin(b)


def trip_lengths(points: DataFrame) -> DataFrame:
    """Points per trip."""
    return points.groupBy("trip").agg(F.count(F.lit(1)).alias("length"))


def trip_endpoints(points: DataFrame, cols: list[str]) -> DataFrame:
    """First and last value of each column in trip order."""
    order = F.struct("time", "seq_i")
    aggs = []
    for c in cols:
        aggs += [F.min_by(c, order).alias(f"first_{c}"), F.max_by(c, order).alias(f"last_{c}")]
    return points.groupBy("trip").agg(*aggs)


def bounding_box(points: DataFrame) -> DataFrame:
    """A06."""
    return points.agg(F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"),
                      F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"))


def attach_road_coords(points: DataFrame, road_info: DataFrame) -> DataFrame:
    """Road lng/lat by a left join; the road table is a dimension table,
    broadcast by Spark's size estimate (AQE switches at run time)."""
    ri = road_info.select("road", F.col("lng").alias("road_lng"), F.col("lat").alias("road_lat"))
    return points.join(ri, "road", "left")
