"""End to end with a hot trip: one trip holds most points (invalid, too long)."""

import datetime as dt

from pyspark.sql import functions as F

from routelens.plans.datasets import TripDatasets

T0 = dt.datetime(2024, 3, 1, 7, 0, 0)


def _tables(spark):
    rows = []
    for i in range(3000):                 # the hot trip
        rows.append((99, T0 + dt.timedelta(seconds=(i // 2) * 5), 1 + i % 40, 0.5,
                     104.0 + (i % 97) / 5000, 30.6 + (i % 89) / 5000, i))
    for t in range(40):                   # ordinary trips of 3..45 points
        for i in range(3 + t):
            rows.append((t, T0 + dt.timedelta(hours=t, seconds=15 * i), (t + i) % 40, 0.25,
                         104.0 + (t * 7 + i) % 50 / 5000, 30.6 + (t * 3 + i) % 50 / 5000, 10_000 + t * 100 + i))
    trips = spark.createDataFrame(rows, "trip long, time timestamp_ntz, road long, road_prop double, "
                                        "lng double, lat double, seq_i long")
    info = trips.select("trip").distinct().withColumn("driver", F.col("trip") % 5)
    return trips, info


def test_hot_trip_chunked_pipeline_equals_plain(spark):
    trips, info = _tables(spark)
    a = TripDatasets(trips, info, chunk_rows=500)        # the hot trip is cut into chunks
    b = TripDatasets(trips, info, chunk_rows=10 ** 6)    # plain window
    assert a.norm_stats.collect() == b.norm_stats.collect()
    fa = sorted(a.trip_features.collect())
    fb = sorted(b.trip_features.collect())
    assert fa == fb and len(fa) > 0
    assert 99 not in {r.trip for r in a.valid.collect()}
    da = {r["column"]: r for r in a.describe_all().collect()}
    db = {r["column"]: r for r in b.describe_all().collect()}
    for c in ("speed", "acceleration", "heading_angle"):
        for k in ("count", "min", "max", "p25", "p50", "p75"):
            assert da[c][k] == db[c][k], (c, k)
