import datetime as dt

from pyspark.sql import functions as F

from routelens.operators import motion
from tests.helpers import close, motion_loop

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)

# trip -> list of (second offset, lng, lat)
CASES = {
    1: [(0, 104.0, 30.6)],                                       # one point
    2: [(0, 104.0, 30.6), (10, 104.001, 30.6005)],               # two points
    3: [(0, 104.0, 30.6), (0, 104.001, 30.601), (10, 104.002, 30.602)],   # equal times
    4: [(0, 104.0, 30.6), (10, 104.0, 30.6), (20, 104.0, 30.6)],          # same place
    5: [(0, 104.0, 30.6), (10, None, 30.601), (20, 104.002, 30.602), (30, 104.003, 30.603)],  # NULL
    6: [(0, 104.0, 30.6), (1, 104.01, 30.61), (2, 104.0, 30.6), (3, 104.01, 30.6)],  # clamps
}


def _frame(spark, cases):
    rows = []
    for trip, pts in cases.items():
        for i, (s, lng, lat) in enumerate(pts):
            rows.append((trip, T0 + dt.timedelta(seconds=s), i, lng, lat))
    df = spark.createDataFrame(rows, "trip long, time timestamp_ntz, seq_i long, lng double, lat double")
    return motion.add_time_features(df)


def _check(result, cases):
    got = {}
    for r in result.collect():
        got[(r["trip"], r["seq_i"])] = (r["speed"], r["acceleration"], r["heading_angle"])
    for trip, pts in cases.items():
        want = motion_loop([(s, lng, lat) for s, lng, lat in pts])
        for i, w in enumerate(want):
            g = got[(trip, i)]
            for a, b in zip(g, w):
                assert close(a, b), (trip, i, g, w)


def test_window_plan_matches_loop(spark):
    _check(motion.motion_features(_frame(spark, CASES)), CASES)


def test_chunked_plan_matches_loop(spark):
    # chunk_rows=1 cuts every multi-point trip into one-point chunks.
    _check(motion.motion_features_all(_frame(spark, CASES), chunk_rows=1), CASES)


def test_hot_trip_chunked_equals_window(spark):
    # One trip holding most rows, with repeated timestamps and gaps.
    rows = [(9, T0 + dt.timedelta(seconds=(i // 3) * 7 + (50 if i > 400 else 0)), i,
             104.0 + (i % 13) / 5000, 30.6 + (i % 7) / 5000) for i in range(600)]
    rows += [(t, T0 + dt.timedelta(seconds=10 * i), i, 104.0 + i / 1000, 30.6) for t in range(20) for i in range(5)]
    df = motion.add_time_features(spark.createDataFrame(
        rows, "trip long, time timestamp_ntz, seq_i long, lng double, lat double"))
    a = {(r.trip, r.seq_i): r for r in motion.motion_features(df).collect()}
    b = {(r.trip, r.seq_i): r for r in motion.motion_features_all(df, chunk_rows=50).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in ("speed", "acceleration", "heading_angle"):
            assert close(a[k][c], b[k][c]), (k, c, a[k][c], b[k][c])


def test_null_speed_is_not_clamped(spark):
    out = motion.motion_features(_frame(spark, {5: CASES[5]})).where("seq_i = 1").first()
    assert out["speed"] is None          # Spark's least/greatest would give -33.33


def test_one_sort_for_motion(spark):
    df = _frame(spark, CASES)
    m = motion.with_positions(motion.motion_features(df))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_session_time_zone_does_not_matter(spark):
    df = _frame(spark, CASES)
    a = [r["seconds"] for r in df.orderBy("trip", "seq_i").collect()]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        b = [r["seconds"] for r in _frame(spark, CASES).orderBy("trip", "seq_i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert a == b


def test_next_point_pairs_and_conv(spark):
    df = motion.with_positions(_frame(spark, {2: CASES[2], 6: CASES[6]}))
    pairs = motion.next_point_pairs(df, ["lng"])
    assert pairs.count() == 1 + 3
    conv = motion.sequence_conv(df.where("trip = 6"), "lng", [1.0, 0.0, 0.0]).orderBy("pos").collect()
    assert conv[0]["conv"] == 0.0 and abs(conv[1]["conv"] - 104.0) < 1e-12
