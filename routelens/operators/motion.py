"""K01 and the other ordered per-trip operators.

All of them share one window specification, partition by ``trip`` ordered by
``(time, seq_i)``, so Spark plans a single exchange and sort per trip table.
Trips are bounded by the length filter before the window on every dataset
path; ``motion_features_all`` handles unbounded (possibly hot) trips for the
all-trip statistics by splitting them into chunks of points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_ACCELERATION, MAX_SPEED, MIN_ACCELERATION, MIN_SPEED
from ..functions.geo import azimuth, clip, haversine
from ..functions.temporal import epoch_seconds, time_of_day, weekday
from .ordinal import row_ordinal

ORDER = ("time", "seq_i")


def trip_window(partition: tuple[str, ...] = ("trip",)):
    return Window.partitionBy(*partition).orderBy(*ORDER)


def add_time_features(trips: DataFrame) -> DataFrame:
    """Seconds, tod, weekday."""
    return (trips.withColumn("seconds", epoch_seconds("time"))
            .withColumn("tod", time_of_day("seconds"))
            .withColumn("weekday", weekday("seconds")))


def _heading(cur_lng, cur_lat, prev_lng, prev_lat, mode: str) -> Column:
    if mode == "reference":
        # Q1: the reference passes (lng, lat, lng, lat) into (lat, lon, lat, lon)
        # and measures from the current point back to the previous one.
        return azimuth(cur_lng, cur_lat, prev_lng, prev_lat)
    if mode == "geodesic":
        return azimuth(prev_lat, prev_lng, cur_lat, cur_lng)
    raise ValueError(f"unknown heading mode {mode!r}")


def _neighbour_features(df: DataFrame, heading: str) -> DataFrame:
    """Speed, acceleration and heading from the point and its neighbours.

    Needs p1_* (previous point), p2_* (the one before), n1_* (next point) and
    has_p1 / has_p2 / has_n1 flags. The previous point's clamped speed is
    recomputed from (p1, p2), so one ordered pass is enough. Distances are
    their own columns first, so each trigonometric expression is evaluated
    once per row (Catalyst does not inline an expensive column it would
    have to repeat).
    """
    def speed_of(dist, dt, has_prev):
        return (F.when(~has_prev, F.lit(0.0))
                .when(dt > 0, clip(dist / dt, MIN_SPEED, MAX_SPEED))
                .otherwise(F.lit(0.0)))

    has_p1, has_p2, has_n1 = F.col("has_p1"), F.col("has_p2"), F.col("has_n1")
    df = (df.withColumn("_dt1", F.col("seconds") - F.col("p1_s"))
          .withColumn("_dt2", F.col("p1_s") - F.col("p2_s"))
          .withColumn("_d1", haversine("lng", "lat", "p1_lng", "p1_lat"))
          .withColumn("_d2", haversine("p1_lng", "p1_lat", "p2_lng", "p2_lat")))
    df = (df.withColumn("speed", speed_of(F.col("_d1"), F.col("_dt1"), has_p1))
          .withColumn("_ps", speed_of(F.col("_d2"), F.col("_dt2"), has_p2))
          .withColumn("_da", F.try_divide(F.col("speed") - F.col("_ps"), F.col("_dt1"))))
    acc = (F.when(~has_p1, F.lit(0.0))
           .when(F.col("_dt1") > 0, clip(F.col("_da"), MIN_ACCELERATION, MAX_ACCELERATION))
           .otherwise(F.lit(0.0)))
    head = (F.when(has_p1, _heading(F.col("lng"), F.col("lat"), F.col("p1_lng"), F.col("p1_lat"), heading))
            # the first point takes the second point's heading (second -> first)
            .when(has_n1, _heading(F.col("n1_lng"), F.col("n1_lat"), F.col("lng"), F.col("lat"), heading))
            .otherwise(F.lit(0.0)))
    return (df.withColumn("acceleration", acc).withColumn("heading_angle", head)
            .drop("_dt1", "_dt2", "_d1", "_d2", "_ps", "_da"))


_NB = ["p1_lng", "p1_lat", "p1_s", "p2_lng", "p2_lat", "p2_s", "n1_lng", "n1_lat",
       "has_p1", "has_p2", "has_n1"]


def _window_neighbours(df: DataFrame, w) -> DataFrame:
    return df.select(
        "*",
        F.lag("lng", 1).over(w).alias("p1_lng"), F.lag("lat", 1).over(w).alias("p1_lat"),
        F.lag("seconds", 1).over(w).alias("p1_s"),
        F.lag("lng", 2).over(w).alias("p2_lng"), F.lag("lat", 2).over(w).alias("p2_lat"),
        F.lag("seconds", 2).over(w).alias("p2_s"),
        F.lead("lng", 1).over(w).alias("n1_lng"), F.lead("lat", 1).over(w).alias("n1_lat"),
        F.lag(F.lit(True), 1).over(w).isNotNull().alias("has_p1"),
        F.lag(F.lit(True), 2).over(w).isNotNull().alias("has_p2"),
        F.lead(F.lit(True), 1).over(w).isNotNull().alias("has_n1"))


def motion_features(points: DataFrame, heading: str = "reference") -> DataFrame:
    """K01 (W01-W04) in one ordered pass: speed, acceleration, heading_angle.

    ``points`` needs trip, time, seq_i, seconds, lng, lat; rows keep all columns.
    Speed = haversine / dt when dt > 0 else 0, clamped to +-33.33 (NULL stays
    NULL); acceleration = (speed - previous clamped speed) / dt, clamped to +-3;
    heading at every point after the first, the first takes the second's, a
    one-point trip gets 0. Use on length-bounded trips (after the validity
    filter); ``motion_features_all`` for trips of any length.
    """
    nb = _window_neighbours(points, trip_window())
    return _neighbour_features(nb, heading).drop(*_NB)


def motion_features_all(points: DataFrame, heading: str = "reference",
                        chunk_rows: int = 200_000, long_trip_limit: int = 100_000,
                        trip_stats: DataFrame | None = None) -> DataFrame:
    """K01 over trips of any length, safe when one trip holds most of the rows.

    Trips longer than ``chunk_rows`` (found by a grouped count, map-side
    combined) are cut into chunks of ``chunk_rows`` points by their ordinal
    (a range partitioning on trip, time and seq_i; NULL times come first, many
    points of one second fall into several chunks); all other trips take the
    plain plan. One window pass over (trip, chunk) gives each point of a long
    trip its neighbours; only the first two rows of a later chunk (and a last
    row) miss one and take it from a small per-chunk table. The list of long
    trips holds at most rows / chunk_rows ids and is broadcast when it has at
    most ``long_trip_limit``. ``trip_stats`` (trip, length) can be passed in
    when the caller already aggregated per trip, saving a pass over the points.
    """
    if trip_stats is None:
        trip_stats = points.groupBy("trip").agg(F.count(F.lit(1)).alias("length"))
    long = trip_stats.where(F.col("length") > chunk_rows).select("trip")
    n_long = long.count()
    if n_long == 0:
        return motion_features(points, heading)
    if n_long <= long_trip_limit:
        long = F.broadcast(long)
    short = motion_features(points.join(long, "trip", "left_anti"), heading)
    ranked = row_ordinal(points.join(long, "trip", "left_semi"), list(ORDER), name="_ord", group="trip")
    df = ranked.withColumn("_chunk", F.floor(F.col("_ord") / chunk_rows).cast("long")).drop("_ord")

    w = trip_window(("trip", "_chunk"))
    nb = _window_neighbours(df, w).withColumn("_rn", F.row_number().over(w))
    # Per-chunk table of long trips: first point, last point and the last
    # point's predecessor inside the chunk. Grouping on the window's own
    # partition keys needs no exchange.
    order = F.struct("time", "seq_i")
    pt = F.struct("lng", "lat", "seconds")
    summ = (nb.groupBy("trip", "_chunk")
            .agg(F.min_by(pt, order).alias("_first"),
                 F.max_by(pt, order).alias("_last"),
                 F.max_by(F.struct(F.col("p1_lng").alias("lng"), F.col("p1_lat").alias("lat"),
                                   F.col("p1_s").alias("seconds"), F.col("has_p1").alias("ok")),
                          order).alias("_last_p1")))
    cw = Window.partitionBy("trip").orderBy("_chunk")
    links = summ.select("trip", "_chunk",
                        F.lag("_last", 1).over(cw).alias("_pl"),
                        F.lag("_last_p1", 1).over(cw).alias("_plp"),
                        F.lag("_last", 2).over(cw).alias("_pll"),
                        F.lead("_first", 1).over(cw).alias("_nf"))
    rn = F.col("_rn")
    needs = ((F.col("_chunk") > 0) & (rn <= 2)) | ((F.col("_chunk") == 0) & (rn == 1) & ~F.col("has_n1"))
    inner = nb.where(~needs)
    edge = nb.where(needs).join(links, ["trip", "_chunk"], "left")
    r1 = (rn == 1) & F.col("_pl").isNotNull()          # first row of a later chunk
    r2 = (rn == 2) & F.col("_pl").isNotNull()          # second row of a later chunk
    # predecessor of the previous chunk's last point: inside that chunk, or
    # the last point of the chunk before it
    pp = lambda f: F.when(F.col("_plp.ok"), F.col(f"_plp.{f}")).otherwise(F.col(f"_pll.{f}"))
    fix = {
        "p1_lng": F.when(r1, F.col("_pl.lng")).otherwise(F.col("p1_lng")),
        "p1_lat": F.when(r1, F.col("_pl.lat")).otherwise(F.col("p1_lat")),
        "p1_s": F.when(r1, F.col("_pl.seconds")).otherwise(F.col("p1_s")),
        "has_p1": F.col("has_p1") | r1,
        "p2_lng": F.when(r1, pp("lng")).when(r2, F.col("_pl.lng")).otherwise(F.col("p2_lng")),
        "p2_lat": F.when(r1, pp("lat")).when(r2, F.col("_pl.lat")).otherwise(F.col("p2_lat")),
        "p2_s": F.when(r1, pp("seconds")).when(r2, F.col("_pl.seconds")).otherwise(F.col("p2_s")),
        "has_p2": F.when(r1, F.col("_plp.ok") | F.col("_pll").isNotNull())
                   .when(r2, F.lit(True)).otherwise(F.col("has_p2")),
        "n1_lng": F.when(~F.col("has_n1") & F.col("_nf").isNotNull(), F.col("_nf.lng")).otherwise(F.col("n1_lng")),
        "n1_lat": F.when(~F.col("has_n1") & F.col("_nf").isNotNull(), F.col("_nf.lat")).otherwise(F.col("n1_lat")),
        "has_n1": F.col("has_n1") | F.col("_nf").isNotNull(),
    }
    for c, e in fix.items():
        edge = edge.withColumn(c, e)
    edge = edge.drop("_pl", "_plp", "_pll", "_nf")
    out = inner.unionByName(edge)
    return short.unionByName(_neighbour_features(out, heading).drop(*_NB, "_chunk", "_rn").select(*short.columns))


def with_positions(points: DataFrame) -> DataFrame:
    """pos (0-based), trip length n and the trip's first/last second (s0, s1)
    over the trip window: same partitioning and sort as K01, no new exchange."""
    w = trip_window()
    wall = Window.partitionBy("trip")
    return (points.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
            .withColumn("n", F.count(F.lit(1)).over(wall).cast("int"))
            .withColumn("s0", F.min("seconds").over(wall))
            .withColumn("s1", F.max("seconds").over(wall)))


def next_point_pairs(points: DataFrame, cols: list[str]) -> DataFrame:
    """Each point with the next point's values as labels; the last point drops."""
    w = trip_window()
    out = points
    for c in cols:
        out = out.withColumn(f"next_{c}", F.lead(c, 1).over(w))
    has_next = F.lead(F.lit(True), 1).over(w).isNotNull()
    return out.withColumn("_hn", has_next).where("_hn").drop("_hn")


def pairwise(points: DataFrame, cols: list[str]) -> DataFrame:
    """Consecutive pairs (a, b) along each trip."""
    return next_point_pairs(points, cols)


def next_point_rows(rows: DataFrame, cols: list[str], keep: tuple[str, ...] = ("split", "trip")) -> DataFrame:
    """W05/W08 on rows that hold their trip as an array ``pts``: each point but
    the last with the next point's ``cols``; no shuffle."""
    pair = F.transform(F.sequence(F.lit(0), F.size("pts") - 2), lambda i: F.struct(
        i.cast("int").alias("pos"), F.get("pts", i).alias("p"),
        *[F.get("pts", i + 1)[c].alias(f"next_{c}") for c in cols]))
    return (rows.where(F.size("pts") > 1).select(*keep, F.explode(pair).alias("_r"))
            .select(*keep, "_r.pos", "_r.p.*", *[f"_r.next_{c}" for c in cols]))


def conv_rows(rows: DataFrame, col: str, kernel: list[float], out: str = "conv", keep: tuple[str, ...] = ("split", "trip")) -> DataFrame:
    """W07 on rows that hold their trip as an array ``pts``; no shuffle."""
    half = (len(kernel) - 1) // 2

    def at(_, i):
        terms = [F.lit(float(w)) * F.coalesce(F.get("pts", i + (j - half))[col], F.lit(0.0)) for j, w in enumerate(kernel)]
        return reduce(lambda a, b: a + b, terms)

    return rows.select(*keep, F.posexplode(F.transform("pts", at)).alias("pos", out))


def sequence_conv(points: DataFrame, col: str, kernel: list[float], out: str = "conv") -> DataFrame:
    """1-D convolution along a trip, zero padding (k-1)/2, caller's kernel."""
    k = len(kernel)
    half = (k - 1) // 2
    w = trip_window()
    terms = []
    for j, wt in enumerate(kernel):
        off = j - half
        if off < 0:
            v = F.lag(col, -off).over(w)
        elif off > 0:
            v = F.lead(col, off).over(w)
        else:
            v = F.col(col)
        terms.append(F.lit(float(wt)) * F.coalesce(v, F.lit(0.0)))
    expr = terms[0]
    for t in terms[1:]:
        expr = expr + t
    return points.withColumn(out, expr)
