"""Type strings, grid road type, saved statistics, prompts, vocabulary, predictions, closing."""
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from routelens import session
from routelens.constants import ANCHOR_WORDS_ZH, PROMPT_PARTS
from routelens.operators import prompts, split
from routelens.plans import TripDatasets, builder, tasks
from routelens.plans.registry import datasets
from tests.conftest import SF001


def test_type_strings():
    assert builder.parse_type("odpois-3-5-1") == ("odpois", (3, 5, 1)) and builder.parse_type("odpois") == ("odpois", (5, 0, 0))
    assert builder.parse_type("hopnegindex-5") == ("hopnegindex", (5, 10000)) and builder.parse_type("trip") == ("trip", ())
    for bad in ("trips", "trip-1", "odpois-x", "hopqrytgt-1-2"):
        with pytest.raises(ValueError):
            builder.parse_type(bad)


def test_dump_and_load(spark, ds_small, tmp_path):
    for name in ("tte", "hopqrytgt-3", "odpois-2-1-1"):
        builder.dump(ds_small, name, str(tmp_path), splits=(0, 2))
        got = builder.load(spark, str(tmp_path), name)
        want = builder.build(ds_small, name, (0, 2)).select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 0
        assert {r.split for r in builder.load(spark, str(tmp_path), name, 2).select("split").collect()} == {2}


def test_statistics_prefer_the_expanded(spark, ds_small, tmp_path):
    builder.write_stats(ds_small, str(tmp_path), expanded=False)
    stat, info = builder.load_stats(spark, str(tmp_path))
    assert stat.where("column = 'speed'").first()["max"] == 0.0 and info.count() == 1
    builder.write_stats(ds_small, str(tmp_path))
    assert builder.load_stats(spark, str(tmp_path))[0].where("column = 'speed'").first()["max"] > 0


def test_grid_type_has_its_own_names(spark, ds_small, tmp_path):
    ds = TripDatasets(ds_small.trips, ds_small.trip_info, ds_small.road_info, ds_small.pois, road_type="grid")
    w, h = ds.dims.select("num_w", "num_h").first()
    c = ds.cardinalities().first()
    assert (c["num_road"], c["num_w"], c["num_h"]) == (w * h, w, h) and ds.road_info.count() == w * h
    assert builder.dump(ds, "destination", str(tmp_path)).endswith("destination_grid")
    assert 0 <= ds.destination_labels().agg(F.max("destination")).first()[0] < w * h
    ds.close()


def test_close_deletes_what_was_written(spark, ds_small):
    ds = TripDatasets(ds_small.trips, ds_small.trip_info, ds_small.road_info, ds_small.pois)
    ds.tte_labels().count()
    paths = [p.removeprefix("file:") for p in ds._written]
    assert paths and all(os.path.isdir(p) for p in paths)
    ds.close()
    assert not any(os.path.isdir(p) for p in paths)


def test_prompts_hold_the_points(spark, ds_small):
    view = ds_small.training_view(2)
    rows = prompts.pretrain_prompts(view, "en", places=False).collect()
    assert len(rows) == view.count() and all(6 <= len(r.points) <= 120 and PROMPT_PARTS["en"]["start"] not in r.before for r in rows)
    both = prompts.pretrain_prompts(view, "en").where("recover_type = 'poi'").collect()
    assert all(r.before.endswith(PROMPT_PARTS["en"]["traj"]) and r.after.startswith(PROMPT_PARTS["en"]["start"]) for r in both)
    one = ds_small.training_view(2, label="driver")
    assert "label" in one.columns and "tte" not in one.columns


def test_vocabulary_leaves_out_known_words(spark):
    vocab = spark.createDataFrame([("弯",), ("[anchor1]",), ("x",)], "word string")
    got = {r.word for r in split.new_vocabulary(vocab, ANCHOR_WORDS_ZH, 3, 3).collect()}
    assert got == {"直", "加", "[anchor0]", "[anchor2]"}


def test_stored_predictions_give_the_reported_metrics(spark, ds_small, tmp_path):
    """What the tasks report is what SQL computes from the predictions they store."""
    path = f"{tmp_path}/tte"
    got = tasks.regression_task(ds_small, "linear", predictions=path).first()
    sql = duckdb.sql(f"SELECT sqrt(avg((pred - label) ** 2)), avg(abs(pred - label)), avg(abs(pred - label) / label) FILTER (label <> 0) FROM '{path}/*.parquet'").fetchall()[0]
    assert sql == pytest.approx((got["rmse"], got["mae"], got["mape"]))
    path = f"{tmp_path}/driver"
    got = tasks.classification_task(ds_small, ds_small.driver_labels(), "driver", reg_params=(0.01,), predictions=path).first()
    sql = duckdb.sql(f"""SELECT avg(coalesce(pred = label, false)::int), avg(coalesce(rank <= 5, false)::int), avg(coalesce(rank <= 10, false)::int),
                         count(*) FILTER (rank IS NULL) FROM '{path}/*.parquet'""").fetchall()[0]
    assert sql == pytest.approx((got["acc@1"], got["acc@5"], got["acc@10"], got["unscored"]))


def test_no_shuffle_for_trip_expressions(spark, ds_small):
    from routelens.plans.registry import QUERIES
    for key in ("kseg_resample", "pairwise", "next_point_pairs", "sequence_conv", "tte_labels", "destination_labels"):
        plan = QUERIES[key](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan, key


def test_dropped_tables(spark):
    mark = session.written_tables()
    session.cut_lineage(spark.range(3))
    assert len(session.written_since(mark)) == 1
    session.drop_tables(spark, session.written_since(mark))
    assert session.written_tables() == mark and datasets is not None


def test_loaders(spark, ds_small, tmp_path):
    from routelens.sources import load_pois, load_road_info, load_trip_info, load_trips
    ds_small.trips.drop("lng", "lat").write.parquet(f"{tmp_path}/trips")
    ds_small.road_info.write.parquet(f"{tmp_path}/roads")
    ds_small.trip_info.write.parquet(f"{tmp_path}/info")
    roads = load_road_info(spark, f"{tmp_path}/roads")
    trips = load_trips(spark, f"{tmp_path}/trips", roads)          # places come from the roads
    assert trips.count() == ds_small.trips.count() and trips.where("lng IS NULL").count() == 0
    assert load_trip_info(spark, f"{tmp_path}/info").count() == ds_small.trip_info.count()
    with pytest.raises(ValueError, match="missing columns"):
        load_trip_info(spark, f"{tmp_path}/roads")
    pois = ds_small.pois.drop("poi_id")
    pois.repartition(1).write.parquet(f"{tmp_path}/p1")
    pois.repartition(5).write.parquet(f"{tmp_path}/p2")
    ids = [sorted(map(tuple, load_pois(spark, f"{tmp_path}/{p}").collect())) for p in ("p1", "p2")]
    assert ids[0] == ids[1] and len({r[0] for r in ids[0]}) == len(ids[0])


def test_split_by_another_order(spark, ds_small):
    info = ds_small.trip_info.withColumn("ord", -F.col("trip"))
    a = {r.trip: r.split for r in TripDatasets(ds_small.trips, info, order="ord").split_info.collect()}
    ids = sorted(a, reverse=True)
    assert all(a[t] == 0 for t in ids[:int(len(ids) * .8)]) and a[ids[-1]] == 2


def test_joined_vectors(spark, ds_small):
    from routelens.operators.vectors import joined_vectors
    both = joined_vectors([ds_small.kseg_vectors(2), ds_small.kseg_vectors(3)]).collect()
    assert len(both) == ds_small.valid.count() and all(len(r.vec) == 10 for r in both)
