"""Split-wise commits, and statistics that know what they are of and can be merged."""
import math
import random

import pytest
from pyspark.sql import functions as F

from routelens.operators import sketches
from routelens.plans import TripDatasets, builder
from routelens.plans.datasets import NUMERIC_POINT_COLS
from routelens.sources import snapshots


def counts(spark, root, name):
    return {r["split"]: r["count"] for r in builder.load(spark, root, name).groupBy("split").count().collect()}


def test_one_split_is_written_without_losing_the_others(spark, ds_small, tmp_path):
    root = str(tmp_path)
    builder.dump(ds_small, "destination", root)
    before = counts(spark, root, "destination")
    assert set(before) == {0, 1, 2}
    builder.dump(ds_small, "destination", root, splits=(2,))
    assert counts(spark, root, "destination") == before
    few = TripDatasets(ds_small.trips.where("trip % 3 = 0"), ds_small.trip_info, ds_small.road_info, ds_small.pois)
    builder.dump(few, "destination", root, splits=(1,))
    after = counts(spark, root, "destination")
    assert (after[0], after[2]) == (before[0], before[2]) and after.get(1, 0) < before[1]
    few.close()


def test_a_failed_write_shows_nothing(spark, ds_small, tmp_path, monkeypatch):
    root = str(tmp_path)
    builder.dump(ds_small, "tte", root, splits=(0, 1))
    before = counts(spark, root, "tte")
    broken = builder.build(ds_small, "tte").withColumn("tte", F.when(F.col("split") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("tte")))
    monkeypatch.setattr(builder, "build", lambda *a: broken)
    with pytest.raises(Exception, match="stop"):
        builder.dump(ds_small, "tte", root)
    assert counts(spark, root, "tte") == before                # staged files of the killed write are there, unread
    monkeypatch.undo()
    with pytest.raises(snapshots.NoSnapshot):
        builder.load(spark, root, "tte", 2)
    with pytest.raises(snapshots.NoSnapshot):
        builder.load(spark, root, "trip")


def test_only_the_asked_split_is_read(spark, ds_small, tmp_path):
    builder.dump(ds_small, "destination", str(tmp_path))
    files = builder.load(spark, str(tmp_path), "destination", 1).inputFiles()
    assert files and all("/split=1/" in f for f in files)


def test_empty_split_and_other_columns(spark, ds_small, tmp_path):
    none = TripDatasets(ds_small.trips.where("trip < 0"), ds_small.trip_info, ds_small.road_info, ds_small.pois)
    path = builder.dump(none, "destination", str(tmp_path), splits=(0,))
    assert builder.load(spark, str(tmp_path), "destination", 0).collect() == []
    none.close()
    snapshots.commit(spark, path, lambda m: {**m, "columns": spark.createDataFrame([], "a int").schema.jsonValue()})
    with pytest.raises(ValueError, match="other columns"):
        builder.dump(ds_small, "destination", str(tmp_path))


def test_two_writers_at_once_both_count(spark, tmp_path):
    path, first = str(tmp_path), []

    def change(m):
        if not first:                                          # another writer commits between our read and our commit
            first.append(1)
            snapshots.commit(spark, path, lambda n: {**n, "other": 1})
        return {**m, "own": 1}

    snapshots.commit(spark, path, lambda m: {"begin": 1})
    assert snapshots.commit(spark, path, change) == {"begin": 1, "other": 1, "own": 1}


def test_replaced_folders_go_two_commits_later(spark, tmp_path):
    path = str(tmp_path)
    names = []
    for i in range(4):
        names.append(snapshots.stage(spark.range(i + 1), path))
        snapshots.commit(spark, path, lambda m: {"table": names[-1]})
    here = [n for n in names if (tmp_path / n).exists()]
    assert here == names[2:]


def test_stale_statistics_are_refused(spark, ds_small, tmp_path):
    root = str(tmp_path)
    builder.write_stats(ds_small, root)
    assert builder.load_stats(spark, root, of=ds_small)[0].where("column = 'speed'").first()["max"] > 0
    half = TripDatasets(ds_small.trips.where("trip % 2 = 0"), ds_small.trip_info, ds_small.road_info, ds_small.pois)
    with pytest.raises(builder.StaleStatistics):
        builder.load_stats(spark, root, of=half)
    builder.write_stats(half, root, expanded=False)            # replaces the expanded ones as well
    stat, _ = builder.load_stats(spark, root, of=half)
    assert stat.where("column = 'seconds'").first()["count"] == half.trips.count()
    with pytest.raises(builder.StaleStatistics):
        builder.merge_stats(half, root)
    half.close()


def test_merged_sketches_equal_one_pass(spark):
    r = random.Random(1)
    rows = [(r.choice([None, float("nan"), 0.0, -0.0, 1.7e9 + i, r.gauss(0, 1), r.expovariate(1) * 1e6, -r.random()]), float(i % 700)) for i in range(6000)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    cells = lambda d: {(x["column"], x["kind"], x["at"]): x["n"] for x in d.collect()}
    parts = [sketches.sketch(df.where(c), ["a", "b"]) for c in ("b < 100", "b between 100 and 101", "b > 101", "b > 1000")]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert cells(sketches.merge(merged)) == cells(sketches.sketch(df, ["a", "b"]))
    values = sorted(x for x, _ in rows if x is not None and not math.isnan(x))
    got = {x["column"]: x for x in sketches.describe(merged).collect()}
    a, mean = got["a"], math.fsum(values) / len(values)
    assert (a["count"], a["min"], a["max"]) == (len(values), values[0], values[-1])
    assert a["mean"] == pytest.approx(mean, rel=1e-12)
    assert a["std"] == pytest.approx(math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (len(values) - 1)), rel=1e-9)
    for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
        assert a[name] == pytest.approx(values[math.floor((len(values) - 1) * q)], rel=0.0051)
    assert got["b"]["distinct"] == pytest.approx(700, rel=0.06) and a["distinct"] == pytest.approx(len(set(values)), rel=0.08)
    assert sketches.describe(sketches.sketch(df.where("b < 0"), ["a"])).collect() == []


def test_fingerprints_add_up(spark):
    df = spark.createDataFrame([(i, None if i % 3 else str(i)) for i in range(50)], "a long, b string")
    whole = sketches.fingerprint(df.repartition(7))
    assert whole == sketches.add_fingerprints(sketches.fingerprint(df.where("a < 20")), sketches.fingerprint(df.where("a >= 20")))
    assert whole != sketches.fingerprint(df.withColumn("b", F.coalesce("b", F.lit("")))) and whole != sketches.fingerprint(df.where("a > 0"))


def test_new_trips_are_merged_without_the_old(spark, ds_small, tmp_path):
    root, part = str(tmp_path), F.col("trip") % 3 == 0
    first, more = (TripDatasets(ds_small.trips.where(c), ds_small.trip_info.where(c), ds_small.road_info, ds_small.pois) for c in (~part, part))
    builder.write_stats(first, root)
    builder.merge_stats(more, root)
    got = {r["column"]: r for r in builder.load_stats(spark, root, of=ds_small)[0].collect()}
    want = {r["column"]: r for r in ds_small.describe_all().collect()}
    assert set(got) == set(NUMERIC_POINT_COLS) == set(want)
    for c in want:
        assert (got[c]["count"], got[c]["min"], got[c]["max"]) == (want[c]["count"], want[c]["min"], want[c]["max"])
        assert got[c]["mean"] == pytest.approx(want[c]["mean"], rel=1e-9, abs=1e-12) and got[c]["std"] == pytest.approx(want[c]["std"], rel=1e-9)
    with pytest.raises(ValueError, match="in the stored"):
        builder.merge_stats(more, root)
    first.close()
    more.close()
