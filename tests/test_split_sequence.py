import datetime as dt

from pyspark.sql import functions as F

from routelens.operators import sequence, split
from routelens.operators.ordinal import row_ordinal

T0 = dt.datetime(2024, 1, 1)


def _pts(spark, lengths, null_trip=None):
    rows = []
    for trip, n in lengths.items():
        for i in range(n):
            lng = None if (trip == null_trip and i == 2) else 104.0 + i / 1000
            rows.append((trip, T0 + dt.timedelta(seconds=10 * i), 1, 0.5, lng, 30.6, i))
    return spark.createDataFrame(rows, "trip long, time timestamp_ntz, road long, road_prop double, "
                                       "lng double, lat double, seq_i long")


def test_valid_trip_bounds(spark):
    pts = _pts(spark, {1: 1, 2: 2, 5: 5, 6: 6, 120: 120, 121: 121, 7: 7}, null_trip=7)
    v = {r.trip for r in split.valid_trips(pts, cols=["time", "road", "road_prop", "lng", "lat", "seq_i"]).collect()}
    assert v == {6, 120}


def test_split_bounds_disjoint_complete(spark):
    for n in (1, 7, 10, 23, 100):
        info = spark.range(n).select((F.col("id") * 3 + 5).alias("trip"))
        s = split.assign_split(info).collect()
        b1, b2 = int(n * 0.8), int(n * 0.9)
        by = sorted(s, key=lambda r: r.trip)
        assert [r.split for r in by] == [0] * b1 + [1] * (b2 - b1) + [2] * (n - b2)


def test_row_ordinal_independent_of_partitions(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k"))
    for parts in (1, 3, 16):
        o = row_ordinal(df, ["k"], num_partitions=parts).collect()
        assert all(r.ordinal == r.k for r in o)


def test_row_ordinal_grouped(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    o = row_ordinal(df, ["k"], group="g", num_partitions=5).collect()
    assert all(r.ordinal == r.k // 3 for r in o)


def _seq(spark, trips):
    rows = [(t, i, n, float(i), float(-i)) for t, n in trips.items() for i in range(n)]
    return spark.createDataFrame(rows, "trip long, pos int, n int, lng double, lat double")


def test_kseg_remainder_goes_last(spark):
    # 7 points into 3 segments: (0,1), (2,3), (4,5,6)
    out = sequence.kseg_long(_seq(spark, {1: 7}), ["lng"], 3).orderBy("seg").collect()
    assert [r.lng for r in out] == [0.5, 2.5, 5.0]


def test_kseg_short_trip_has_empty_segments(spark):
    out = sequence.kseg_long(_seq(spark, {1: 2}), ["lng"], 3).orderBy("seg").collect()
    assert [r.lng for r in out] == [None, None, 0.5]


def test_hop_split_even_odd(spark):
    h = sequence.hop_split(_seq(spark, {1: 5})).collect()
    q = sorted(r.pos for r in h if r.role == "qry")
    t = sorted(r.pos for r in h if r.role == "tgt")
    assert q == [0, 2, 4] and t == [1, 3]


def test_first_n_trips(spark):
    v = spark.createDataFrame([(t, 0) for t in (5, 3, 9, 1)] + [(11, 1)], "trip long, split int")
    r = sequence.first_n_trips(v, 10).collect()
    assert sorted((x.split, x.idx, x.trip) for x in r) == [(0, 0, 1), (0, 1, 3), (0, 2, 5)]


def test_batches_drop_single_tail(spark):
    df = spark.range(0, 33).select(F.col("id").alias("ordinal"))
    b = split.batch_assign(df, 16).collect()
    assert len(b) == 32


def test_extrapolation(spark):
    rows = [(1, i, 4, 104.0 + 0.01 * i, 30.0, float(10 * i)) for i in range(4)]
    pts = spark.createDataFrame(rows, "trip long, pos int, n int, lng double, lat double, seconds double")
    # cut n - 1 - pre = 2 points: a = pos 1, b = pos 0; 0.01 degrees per 10 s
    e = sequence.extrapolate_trip(pts, 1).collect()[0]
    assert abs(e.lng - (104.01 + 0.001)) < 1e-12 and e.seconds == 20.0


def test_exact_order_stats_multipass(spark):
    from routelens.operators.stats import describe, exact_order_stats
    rows = [("a", float(v)) for v in [5, 1, 1, 1, 9, 3, 3, 7, 2, 8, 1e9, -4]] + \
           [("b", float((i * 7919) % 101) / 7) for i in range(400)] + [("c", 2.5)] * 50
    long = spark.createDataFrame(rows, "column string, value double")
    vals = {}
    for c, v in rows:
        vals.setdefault(c, []).append(v)
    targets = {(c, k): (min(v), max(v)) for c, v in vals.items() for k in {0, len(v) // 3, len(v) // 2, len(v) - 1}}
    got = exact_order_stats(long, targets, buckets=3, window=2)
    assert all(got[(c, k)] == sorted(vals[c])[k] for (c, k) in targets)
    wide = spark.createDataFrame([(float(v),) for v in vals["b"]], "b double")
    a = describe(wide, ["b"], "exact").first()
    s = describe(wide, ["b"], "sort").first()
    assert (a.p25, a.p50, a.p75) == (s.p25, s.p50, s.p75)
