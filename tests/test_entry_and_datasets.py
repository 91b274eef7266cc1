import importlib

from pyspark.sql import functions as F

from tests.conftest import SF001


def test_entry_runs(spark):
    E = importlib.import_module("__spark_entry__")
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"trip", "tte", "mean_speed", "start_weekday", "start_hour", "destination"}


def test_every_query_runs_at_smallest_scale(spark):
    """Every key of the trajectory part, with the columns that its SQL names."""
    from routelens.oracle import ORACLE_SQL
    from routelens.plans.registry import QUERIES
    E = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries()) and set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE_SQL) == {"ann_search", "destination_model", "driver_model", "select_model", "tte_model"}
    for k, q in QUERIES.items():
        if not k.endswith("_model") or k == "select_model":         # the models have a test of their own
            assert q(spark, SF001).count() > 0, k


def test_splits_and_hop_properties(ds_small):
    v = ds_small.valid.collect()
    assert len({r.trip for r in v}) == len(v)
    hq = ds_small.hop_query_target(5)
    tf = ds_small.trip_features
    a = hq.groupBy("trip").agg(F.count("*").alias("c"))
    b = tf.join(hq.select("trip").distinct(), "trip").groupBy("trip").agg(F.count("*").alias("c"))
    assert sorted(a.collect()) == sorted(b.collect())      # query + target = the trip


def test_denormalize_round_trip(ds_small):
    from routelens.operators import stats
    tf = ds_small.trip_features.where("split = 2")
    back = stats.denormalize(tf, ds_small.norm_stats, ["lng", "lat"]).select("trip", "pos", "lng", "lat")
    raw = ds_small.valid_points.select("trip", "pos", F.col("lng").alias("rl"), F.col("lat").alias("ra"))
    d = back.join(raw, ["trip", "pos"]).agg(F.max(F.abs(F.col("lng") - F.col("rl"))),
                                            F.max(F.abs(F.col("lat") - F.col("ra")))).first()
    assert d[0] < 1e-9 and d[1] < 1e-9


def test_meta_roundtrip_prunes_partitions(spark, ds_small):
    from routelens.sources.io import read_meta, write_meta
    path = write_meta(ds_small.trip_features, "trip")
    df = read_meta(spark, path, split=2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan
    assert df.count() == ds_small.trip_features.where("split = 2").count()


def test_no_cartesian_without_broadcast(spark):
    E = importlib.import_module("__spark_entry__")
    for k in ("od_pois", "knn_poi", "trip_features", "similar_search"):
        plan = E.queries()[k](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, k


def test_a_dataset_of_one_split_searches_places_for_that_split_alone(spark, monkeypatch):
    from routelens.operators import poi
    from routelens.plans import builder
    from routelens.plans.registry import datasets
    ds, seen, real = datasets(spark, SF001), [], poi.knn_poi
    monkeypatch.setattr(poi, "knn_poi", lambda q, *a: seen.append(q) or real(q, *a))
    whole = sorted(r[:] for r in builder.build(ds, "odpois-3").where("split = 1").collect())
    one = sorted(r[:] for r in builder.build(ds, "odpois-3", splits=(1,)).collect())
    assert whole == one and seen[1].count() <= 2 * len(one) < seen[0].count()
