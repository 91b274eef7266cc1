from pyspark.sql import functions as F

from routelens.operators import poi, search
from routelens.sources.fixture import fixture_pois_large, fixture_tables
from tests.conftest import SF001


def _queries(spark):
    fx = fixture_tables(spark, SF001)
    q = fx["trips"].where("lng IS NOT NULL").groupBy("trip").agg(F.min("lng").alias("lng"), F.min("lat").alias("lat"))
    return fx, q.select(F.col("trip").alias("qid"), "lng", "lat")


def test_grid_equals_broadcast_with_ties(spark):
    fx, q = _queries(spark)
    pl = fx["pois_large"]      # keys 1000 apart share a place: ties broken by poi_id
    a = sorted((r.qid, r.rank, r.poi_id) for r in poi.knn_poi(q, pl, 4).collect())
    p = pl.withColumn("dummy", F.lit(1))
    w = q.crossJoin(p.select("poi_id", F.col("lng").alias("plng"), F.col("lat").alias("plat")))
    w = w.withColumn("d", (F.col("plng") - F.col("lng")) ** 2 + (F.col("plat") - F.col("lat")) ** 2)
    from pyspark.sql import Window
    w = w.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d", "poi_id")) - 1).where("rank < 4")
    b = sorted((r.qid, r.rank, r.poi_id) for r in w.collect())
    assert a == b


def test_k_larger_than_table(spark):
    fx, q = _queries(spark)
    small = fx["pois"].limit(2)
    assert poi.knn_poi(q, small, 5).groupBy("qid").count().agg(F.max("count")).first()[0] == 2



def _vecs(spark, n):
    return spark.createDataFrame([(i, [float(i % 17), float((i * 7) % 11)]) for i in range(n)], "item long, vec array<double>")


def test_vector_topk_exact(spark):
    items = _vecs(spark, 300).repartition(7)
    qs = spark.createDataFrame([(5, [1.0, 2.0]), (6, [10.0, 0.0])], "qid long, vec array<double>")
    got = sorted((r.qid, r.rank, r.item) for r in search.vector_topk(qs, items, 10).collect())
    loc = []
    rows = items.collect()
    for qid, qv in ((5, [1.0, 2.0]), (6, [10.0, 0.0])):
        d = sorted(((sum((a - b) ** 2 for a, b in zip(r.vec, qv))) ** 0.5, r.item) for r in rows)[:10]
        loc += [(qid, i, it) for i, (_, it) in enumerate(d)]
    assert got == sorted(loc)


def test_negatives_avoid_near_and_are_distinct(spark):
    items = _vecs(spark, 200)
    qs = items.where("item < 4").select(F.col("item").alias("qid"), "vec")
    neg = search.sample_negatives(qs, items, 30, seed=3)
    near = {(r.qid, r.item) for r in search.nearest_set(qs, items, 10).collect()}
    rows = neg.collect()
    assert len(rows) == 4 * 30
    assert not any((r.qid, r.item) in near for r in rows)
    assert len({(r.qid, r.item) for r in rows}) == len(rows)
    assert sorted(r.neg_idx for r in rows if r.qid == 0) == list(range(1, 31))
    again = {(r.qid, r.item, r.neg_idx) for r in search.sample_negatives(qs, items, 30, seed=3).collect()}
    assert again == {(r.qid, r.item, r.neg_idx) for r in rows}


def test_negatives_capped_and_small_sets(spark):
    items = _vecs(spark, 25)
    qs = items.where("item < 2").select(F.col("item").alias("qid"), "vec")
    neg = search.sample_negatives(qs, items, 100, seed=1).collect()    # min(25 - 2, 100) = 23 > 15 candidates
    per = {}
    for r in neg:
        per.setdefault(r.qid, set()).add(r.item)
    assert all(len(v) == 15 for v in per.values())          # all but the 10 nearest
    few = _vecs(spark, 8)
    q2 = few.where("item < 2").select(F.col("item").alias("qid"), "vec")
    far = search.sample_negatives(q2, few, 4, seed=1).collect()  # <= 10 trips: the 4 farthest
    assert len(far) == 8


def test_grid_exact_with_hot_cluster_and_copies(spark):
    import random
    rnd = random.Random(5)
    pois = []
    pid = 0
    for _ in range(3000):        # a hot cluster: most places in a tiny square
        pois.append((pid, f"c{pid}", "A", 104.0 + rnd.random() * 1e-4, 30.6 + rnd.random() * 1e-4)); pid += 1
    for _ in range(300):         # many copies of one location
        pois.append((pid, f"d{pid}", "B", 104.01, 30.61)); pid += 1
    for _ in range(200):         # sparse places around
        pois.append((pid, f"s{pid}", "C", 104.0 + rnd.random() * 0.05, 30.6 + rnd.random() * 0.05)); pid += 1
    P = spark.createDataFrame(pois, "poi_id long, name string, address string, lng double, lat double")
    qs = [(i, 104.0 + rnd.random() * 0.05, 30.6 + rnd.random() * 0.05) for i in range(60)]
    qs += [(100 + i, 104.0 + rnd.random() * 1e-4, 30.6 + rnd.random() * 1e-4) for i in range(20)]
    qs += [(200, 104.01, 30.61), (201, 104.0102, 30.6101)]
    Q = spark.createDataFrame(qs, "qid long, lng double, lat double")
    got = sorted((r.qid, r.rank, r.poi_id) for r in poi.knn_poi(Q, P, 5).collect())
    want = []
    for qid, x, y in qs:
        d = sorted((((px - x) * (px - x) + (py - y) * (py - y)), i) for i, _, _, px, py in pois)[:5]
        want += [(qid, r, i) for r, (_, i) in enumerate(d)]
    assert got == sorted(want)


def test_vector_topk_two_level_merge(spark):
    items = _vecs(spark, 2000).repartition(100)            # > 64 tasks: two-level merge
    qs = spark.createDataFrame([(5, [1.0, 2.0])], "qid long, vec array<double>")
    rows = items.collect()
    for largest in (False, True):
        got = [r.item for r in sorted(search.vector_topk(qs, items, 30, largest=largest).collect(), key=lambda r: r.rank)]
        sgn = -1 if largest else 1
        want = [it for _, it in sorted((sgn * sum((a - b) ** 2 for a, b in zip(r.vec, [1.0, 2.0])) ** 0.5, r.item)
                                       for r in rows)[:30]]
        assert got == want
