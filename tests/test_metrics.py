import math
import random

from pyspark.sql import functions as F

from routelens.operators import metrics
from routelens.operators.vectors import anchor_scores


def _scores(spark, rows):
    return spark.createDataFrame(rows, "id long, cls long, score double")


def test_argmax_ties_lowest_class(spark):
    s = _scores(spark, [(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9), (2, 3, 1.0), (2, 1, 1.0)])
    got = {r.id: r.pred for r in metrics.argmax_class(s).collect()}
    assert got == {1: 1, 2: 1}


def test_rank_ties_higher_class_first(spark):
    s = _scores(spark, [(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.1)])
    lab = spark.createDataFrame([(1, 1)], "id long, label long")
    assert metrics.truth_rank(s, lab).first()["rank"] == 2     # class 2 ahead of 1, class 0 behind
    r = {x.cls: x.rank for x in metrics.score_rank(s).collect()}
    assert r == {2: 1, 1: 2, 0: 3, 3: 4}


def test_macro_scores_with_zero_fill(spark):
    # truth 0,0,1 ; predictions 0,2,1 -> classes {0,1,2}
    s = _scores(spark, [(1, 0, 1.0), (1, 2, 0.0), (2, 2, 1.0), (2, 0, 0.0), (3, 1, 1.0), (3, 0, 0.0)])
    lab = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, label long")
    m = metrics.classification_metrics(s, lab, ns=(1, 2)).first()
    f1 = (2 * 1 / (2 + 1) + 1.0 + 0.0) / 3      # class 0: tp 1, true 2, pred 1; class 1 perfect; class 2 none
    rec = (0.5 + 1.0 + 0.0) / 3
    assert math.isclose(m["macro_f1"], f1) and math.isclose(m["macro_rec"], rec)
    assert math.isclose(m["acc@1"], 2 / 3)


def test_mape_skips_zero_labels(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 12.0), (20.0, 10.0)], "label double, pred double")
    m = metrics.regression_metrics(df).first()
    assert m["mape_skipped"] == 1 and math.isclose(m["mape"], (0.2 + 0.5) / 2)
    assert math.isclose(m["rmse"], math.sqrt((1 + 4 + 100) / 3))


def test_cross_entropy_uniform(spark):
    s = _scores(spark, [(1, c, 0.0) for c in range(4)])
    lab = spark.createDataFrame([(1, 2)], "id long, label long")
    assert math.isclose(metrics.cross_entropy(s, lab).first()[0], math.log(4))


def test_scores_on_the_row_are_the_long_form(spark):
    """Ties, missing scores, labels without a score, rows without scores: both forms give the same; the array form doesn't shuffle."""
    r = random.Random(6)
    rows = [(i, r.choice([None, 0, 1, 2, 7]) if i % 5 == 0 else r.randrange(5),
             [(c, r.choice([None, 0.1, 0.2, 0.3, 0.4])) for c in r.sample(range(5), r.randint(0, 5))]) for i in range(300)] + [(300, 1, None)]
    df = spark.createDataFrame(rows, "id long, label long, scores array<struct<cls:long,score:double>>").repartition(3)
    flat = df.select("id", F.explode("scores").alias("s")).select("id", "s.cls", "s.score")
    labels = df.select("id", "label")
    per = metrics.per_row(df)
    assert sorted(map(tuple, per.collect()), key=str) == sorted(map(tuple, metrics.per_example(flat, labels).collect()), key=str)
    a, b = metrics.metrics_of_examples(per).first(), metrics.classification_metrics(flat, labels).first()
    assert all(math.isclose(x, y) for x, y in zip(a, b))
    a, b = metrics.entropy_of_rows(df).first(), metrics.cross_entropy(flat, labels).first()
    assert math.isclose(a[0], b[0]) and a[1] == b[1]
    one = spark.createDataFrame(rows, df.schema)
    assert "Exchange" not in metrics.per_row(one)._jdf.queryExecution().executedPlan().toString()


def test_anchor_scores_in_blocks(spark):
    r = random.Random(7)
    rows = [(i, [r.random() for _ in range(3)] if i else None) for i in range(50)]
    anchors = [(c, [r.random() for _ in range(3)]) for c in range(11)]
    A = spark.createDataFrame(anchors, "anchor long, avec array<double>")
    R = spark.createDataFrame(rows, "id long, vec array<double>")
    for block in (4, 512):
        for x in anchor_scores(R, A, block=block).collect():
            assert [s["cls"] for s in x["scores"]] == list(range(11))
            for s, (_, a) in zip(x["scores"], anchors):
                assert s["score"] is None if x["vec"] is None else math.isclose(s["score"], -math.dist(x["vec"], a))
    assert all(x["scores"] == [] for x in anchor_scores(R, A.limit(0)).collect())
