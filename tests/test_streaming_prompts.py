import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from routelens.operators.prompts import prefix as _prefix
from routelens.streaming import point_feature_stream, point_features


def test_stream_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="rl-stream-", dir="/tmp")
    src, sink, ck = (os.path.join(root, x) for x in ("src", "sink", "ck"))
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(hours=5 * i), i) for i in range(30)]
    df = spark.createDataFrame(rows, "trip long, time timestamp_ntz, seq_i long")
    df.write.parquet(src)
    q = point_feature_stream(spark, src, df.schema, sink, ck)
    q.awaitTermination(120)
    got = sorted((r.seq_i, r.weekday, r.hour) for r in spark.read.parquet(sink).collect())
    want = sorted((r.seq_i, r.weekday, r.hour) for r in point_features(df).collect())
    assert got == want and len(got) == 30


def test_prompt_prefix_languages(spark):
    df = spark.createDataFrame([(0, 8), (6, 23)], "wd int, h int")
    zh = [r[0] for r in df.select(_prefix(F.col("wd"), F.col("h"), "zh")).collect()]
    en = [r[0] for r in df.select(_prefix(F.col("wd"), F.col("h"), "en")).collect()]
    assert zh == ["这条轨迹发生于周一的8点，", "这条轨迹发生于周日的23点，"]
    # hour and weekday in their own places (the reference swaps them, Q8)
    assert en == ["This trajectory happened at 8 o'clock on Monday, ",
                  "This trajectory happened at 23 o'clock on Sunday, "]


def test_od_destination_is_second_to_last(ds_small):
    od = ds_small.od_points(0).where("end = 'd'").select("trip", "lng", "lat")
    vp = ds_small.valid_points.where(F.col("pos") == F.col("n") - 2).select("trip", "lng", "lat")
    assert sorted(od.collect()) == sorted(vp.collect())
    # a cut longer than the trip gives no destination row (NULL text), not an error
    assert ds_small.od_points(200).where("end = 'd'").count() == 0
