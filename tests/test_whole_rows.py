"""No row is lost: odd vectors, NULL times, bursts, unscored truths, odd values, large and far place tables."""
import math
import random

import pytest
from pyspark.sql import functions as F

from routelens.operators import metrics, motion, poi, search, split, stats
from routelens.plans.registry import QUERIES, finish
from tests.conftest import SF001


def test_a_missing_vector_drops_only_itself(spark):
    rows = [(i, [float(i), 0.0]) for i in range(20)] + [(100, None), (101, [None, 1.0])]
    items = spark.createDataFrame(rows, "item long, vec array<double>").coalesce(1)
    qs = spark.createDataFrame([(0, [0.0, 0.0]), (1, None)], "qid long, vec array<double>")
    assert sorted((r.qid, r.item) for r in search.vector_topk(qs, items, 3).collect()) == [(0, 0), (0, 1), (0, 2)]


def test_a_vector_of_another_length_is_an_error(spark):
    items = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0])], "item long, vec array<double>")
    qs = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, vec array<double>")
    with pytest.raises(Exception, match="different length"):
        search.vector_topk(qs, items, 3).collect()


def test_topk_in_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    rng = random.Random(3)
    vec = lambda: [float(rng.randrange(3)), float(rng.randrange(3))]
    items, qs = [(i, vec()) for i in range(150)], [(i, vec()) for i in range(9)]
    I = spark.createDataFrame(items, "item long, vec array<double>").repartition(5)  # noqa: E741
    Q = spark.createDataFrame(qs, "qid long, vec array<double>")
    for largest in (False, True):
        want = {(q, r, i) for q, a in qs for r, (_, i) in enumerate(sorted(((-1 if largest else 1) * math.dist(a, b), i) for i, b in items)[:7])}
        assert {(r.qid, r.rank, r.item) for r in search.vector_topk(Q, I, 7, largest=largest).collect()} == want


def test_seeded_negatives_with_more_trips_than_queries(spark):
    """N = 1000 queries of 4000 trips, M = 500: whole, distinct, near set left out, others by the seeded order."""
    rng = random.Random(2)
    rows = [(i, [rng.random(), rng.random()]) for i in range(4000)]
    items = spark.createDataFrame(rows, "item long, vec array<double>").repartition(8)
    qs = items.where("item < 1000").select(F.col("item").alias("qid"), "vec")
    neg = search.sample_negatives(qs, items, 500, seed=5)
    per = neg.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("d"), F.max("neg_idx").alias("x"))
    assert per.where("n <> 500 OR d <> 500 OR x <> 500").count() == 0 and per.count() == 1000
    assert neg.join(search.nearest_set(qs, items, 10), ["qid", "item"]).count() == 0
    far = search.sample_negatives(qs.where("qid < 5"), items, 3000, mode="farthest")
    dist = sorted((math.dist(rows[0][1], v) for _, v in rows), reverse=True)[:3000]
    got = [r.item for r in far.where("qid = 0").orderBy("neg_idx").collect()]
    assert len(got) == 2990 or len(got) == 3000
    assert all(abs(math.dist(rows[0][1], rows[i][1]) - d) < 1e-12 for i, d in zip(got, dist))


def _points(spark, rows):
    df = spark.createDataFrame(rows, "trip long, seq_i long, sec double, lng double, lat double").repartition(4)
    return df.withColumn("time", F.timestamp_seconds("sec")).withColumn("seconds", F.col("sec"))


def _motion(df):
    return sorted(((r.trip, r.seq_i, r.speed, r.acceleration, r.heading_angle) for r in df.collect()), key=str)


def test_chunks_keep_null_times_and_split_bursts(spark):
    rng = random.Random(1)
    rows = [(1, i, None if i % 11 == 0 else float(i * 10 % 400), 104 + rng.random() / 10, None if i == 30 else 30.6 + rng.random() / 10) for i in range(43)]
    rows += [(2, i, 500.0, 104 + rng.random() / 10, 30.6) for i in range(200)]                 # one second
    rows += [(3, i, float(i), 104.0, 30.6) for i in range(4)]
    pts = _points(spark, rows)
    for chunk in (7, 10):
        assert _motion(motion.motion_features_all(pts, chunk_rows=chunk)) == _motion(motion.motion_features(pts))


def test_no_chunk_is_larger_than_asked(spark, monkeypatch):
    pts = _points(spark, [(2, i, 500.0, 104.0, 30.6) for i in range(1001)])
    seen = []
    real = motion._window_neighbours
    monkeypatch.setattr(motion, "_window_neighbours", lambda df, w: seen.append(df) or real(df, w))
    motion.motion_features_all(pts, chunk_rows=10)
    chunked = next(d for d in seen if "_chunk" in d.columns)
    assert chunked.groupBy("trip", "_chunk").count().agg(F.max("count")).first()[0] == 10


def test_unscored_truths_are_misses(spark):
    scores = spark.createDataFrame([(1, 0, .9), (1, 1, .1), (2, 0, .9), (2, 1, .1)], "id long, cls long, score double")
    labels = spark.createDataFrame([(1, 0), (2, 7), (3, 0)], "id long, label long")
    m = metrics.classification_metrics(scores, labels).first().asDict()
    assert m["acc@1"] == pytest.approx(1 / 3) and m["acc@5"] == pytest.approx(1 / 3)
    assert m["mean_rank"] == pytest.approx((1 + 3 + 3) / 3) and m["unscored"] == 2


def test_finish_passes_odd_values(spark):
    odd = [1e13, 1.7e308, float("inf"), float("-inf"), 1.23456789, -1e-9]
    got = [r.x for r in finish(spark.createDataFrame([(i, x) for i, x in enumerate([*odd, float("nan"), None])], "i int, x double")).orderBy("i").collect()]
    assert got[:4] == odd[:4] and got[4] == 1.234568 and got[5] == 0.0 and math.isnan(got[6]) and got[7] is None


def _nearest(pois, x, y, k):
    return [i for _, i in sorted(((px - x) * (px - x) + (py - y) * (py - y), i) for i, px, py in pois)[:k]]


def test_large_place_table_far_points_and_a_hot_cell(spark):
    rng = random.Random(5)
    pois = [(i, 104 + rng.random() / 20, 30.6 + rng.random() / 20) for i in range(2001)]
    pois += [(3000 + i, 104.02 + rng.random() * 1e-7, 30.62 + rng.random() * 1e-7) for i in range(1500)]
    P = spark.createDataFrame([(i, f"n{i}", "a", x, y) for i, x, y in pois], "poi_id long, name string, address string, lng double, lat double")
    qs = [(1, 104.15, 30.7), (2, 0.0, 0.0), (3, 104.02, 30.62), (4, 104.0200001, 30.6200002), (5, 104.01, 30.61), (6, -170.0, 89.0), (7, None, 1.0)]
    qs += [(100 + i, 104 + rng.random() / 15, 30.6 + rng.random() / 15) for i in range(40)]
    nb = poi.knn_poi(spark.createDataFrame(qs, "qid long, lng double, lat double"), P, 4)
    got = {}
    for r in nb.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.poi_id)
    assert got == {q: _nearest(pois, x, y, 4) for q, x, y in qs if x is not None}


def test_candidates_of_a_far_point_are_few(spark, monkeypatch):
    rng = random.Random(6)
    P = spark.createDataFrame([(i, "n", "a", 104 + rng.random(), 30 + rng.random()) for i in range(20000)], "poi_id long, name string, address string, lng double, lat double")
    seen = []
    real = poi._topk
    monkeypatch.setattr(poi, "_topk", lambda c, k, salted=False: seen.append(c) or real(c, k, salted))
    poi.knn_poi(spark.createDataFrame([(1, 103.9, 30.5), (2, 0.0, 0.0), (3, 104.5, 30.5)], "qid long, lng double, lat double"), P, 3)
    assert seen[0].groupBy("qid").count().agg(F.max("count")).first()[0] < 500


def test_order_statistics_of_the_widest_columns(spark):
    rng = random.Random(9)
    vals = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 308) for _ in range(3000)]
    df = spark.createDataFrame([(v, 1.5) for v in vals], "a double, b double")
    targets = {("a", k): (min(vals), max(vals)) for k in (0, 700, 1500, 2999)}
    got = stats.exact_order_stats(stats._stack(df, ["a", "b"]).select("column", "value"), targets, window=5)
    assert {k: got[("a", k)] for k in (0, 700, 1500, 2999)} == {k: sorted(vals)[k] for k in (0, 700, 1500, 2999)}


def test_grid_keeps_all_points(spark):
    n = spark.read.parquet(f"{SF001}/events.parquet").count()
    assert QUERIES["grid_project"](spark, SF001).count() == n


def test_seeded_shuffle_is_an_order_of_all_rows(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(50)], "trip long, split int")
    a = {(r.split, r.trip): r.shuffled for r in split.seeded_shuffle(df, 1, ["trip"], group="split").collect()}
    b = {(r.split, r.trip): r.shuffled for r in split.seeded_shuffle(df.repartition(7), 1, ["trip"], group="split").collect()}
    c = {(r.split, r.trip): r.shuffled for r in split.seeded_shuffle(df, 2, ["trip"], group="split").collect()}
    assert a == b != c and sorted(v for (s, _), v in a.items() if s == 0) == list(range(25))


def test_nothing_stays_persisted(spark):
    from routelens.plans.registry import datasets
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    datasets(spark, SF001).similar_search(3, 3).collect()
    QUERIES["train_val_test_split"](spark, SF001).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_checkpoint_folder_is_asked_for_on_a_cluster(monkeypatch):
    from routelens import session

    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_nearest_places_cost_a_level_once_and_more_queries_make_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(poi, "TASK_QUERIES", 50, raising=False)
    P = spark.createDataFrame([(i, f"n{i}", "a", 104 + (i * 37 % 211) / 1000, 30 + (i * 91 % 223) / 1000) for i in range(3000)],
                              "poi_id long, name string, address string, lng double, lat double")
    qs = [(i, 104 + (i * 53 % 199) / 1000, 30 + (i * 17 % 197) / 1000) for i in range(1000)]
    nb = poi.knn_poi(spark.createDataFrame(qs, "qid long, lng double, lat double"), P, 2)
    plan = nb._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Window [") <= 12 and plan.count("sum(cnt") <= 12         # a level's window stands in the plan once
    assert any("RepartitionByExpression [qid" in line and line.endswith(", 20") for line in plan.split("\n"))


@pytest.mark.parametrize("k", [7, 90])
def test_topk_measures_chunks_as_matrices(spark, monkeypatch, k):
    """Small k (best of each chunk) and large k (bins first), by group, with ties: as brute force; no distance is a lambda on a joined pair."""
    monkeypatch.setattr(search, "CHUNK", 50, raising=False)
    rng = random.Random(8)
    vec = lambda: [float(rng.randrange(4)), float(rng.randrange(4)), rng.random() if rng.random() < 0.5 else 0.5]
    items, qs = [(i, i % 3, vec()) for i in range(600)], [(i, i % 2, vec()) for i in range(12)]
    I = spark.createDataFrame(items, "item long, g int, vec array<double>").repartition(3)  # noqa: E741
    Q = spark.createDataFrame(qs, "qid long, g int, vec array<double>")
    far = lambda a, b: math.sqrt(sum([(y - x) * (y - x) for x, y in zip(a, b)]))
    for largest in (False, True):
        top = search.vector_topk(Q, I, k, largest=largest, group="g")
        want = {(q, r, i) for q, g, a in qs for r, (_, i) in enumerate(sorted(((-1 if largest else 1) * far(a, b), i) for i, h, b in items if h == g)[:k])}
        assert {(r.qid, r.rank, r.item) for r in top.collect()} == want
        assert "zip_with" not in (plan := top._jdf.queryExecution().optimizedPlan().toString()) and "zipwith" not in plan and "mapinarrow" in plan.lower()
