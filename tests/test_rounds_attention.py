"""Patience, attention in one pass, examples whose truth has no score."""
import math
import random

import numpy as np
import pytest

from routelens.operators import metrics
from routelens.operators.vectors import anchor_attention
from routelens.plans.rounds import fit_rounds, fit_with_patience


def test_patience_returns_the_best_round():
    scores = [0.1, 0.5, 0.4, 0.7, 0.7, None, float("nan"), 0.6, 0.9]
    got = fit_with_patience(np.array([0.0]), lambda s, r: s + 1, lambda s: scores[int(s[0])], patience=4, max_rounds=50)
    assert (got.round, got.score, got.state[0], got.rounds) == (3, 0.7, 3.0, 7)            # 0.9 comes too late
    assert fit_with_patience(np.array([0.0]), lambda s, r: s + 1, lambda s: -s[0], patience=2).round == 0
    assert fit_with_patience(np.array([0.0]), lambda s, r: s + 1, lambda s: s[0], patience=2, max_rounds=9).rounds == 9


def _made_up(spark, classes):
    r = random.Random(8)
    rows = []
    for i in range(900):
        x = [r.gauss(0, 1) * 5 + 3, r.gauss(0, 1), 1.0]
        label = float(x[0] + x[1] > 3) if classes else 200 + 10 * x[0] - 3 * x[1]
        if i % 3 == 1:                                         # the validation split has noise: more rounds don't help for ever
            label = label if r.random() < 0.8 else (1 - label if classes else label * 1.5)
        rows.append((i % 3, i, label, x))
    return spark.createDataFrame(rows, "split int, trip long, label double, features array<double>").repartition(4)


@pytest.mark.parametrize("classes", [0, 2])
def test_rounds_stop_early_and_learn(spark, classes):
    data = _made_up(spark, classes)
    model, best = fit_rounds(data, classes, patience=3, max_rounds=40, rate=0.3)
    assert best.rounds <= 40 and best.rounds == min(40, best.round + 3)
    assert best.score == max(best.history) and best.history.index(best.score) == best.round
    test = model.predict(data.where("split = 2"), best.state).collect()
    if classes:
        assert sum(t["prediction"] == t["label"] for t in test) > 0.9 * len(test)
    else:
        mean = sum(t["label"] for t in test) / len(test)
        assert sum(abs(t["prediction"] - t["label"]) for t in test) < 0.6 * sum(abs(mean - t["label"]) for t in test)


def test_attention_in_blocks_equals_the_plain_sum(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 9) for _ in range(5)]) for i in range(40)] + [(99, None)]
    anchors = [(i, [r.gauss(0, 9) for _ in range(5)]) for i in range(23)]
    frame = spark.createDataFrame(rows, "vec_id long, vec array<double>").repartition(3)
    listed = spark.createDataFrame(anchors, "anchor long, avec array<double>")
    for block in (512, 9):
        for got in anchor_attention(frame, listed, block=block).collect():
            if got["vec"] is None:
                assert got["attended"] is None
                continue
            s = np.array([np.dot(got["vec"], a) / math.sqrt(5) for _, a in anchors])
            w = np.exp(s - s.max())
            assert np.allclose(got["attended"], (w / w.sum()) @ np.array([a for _, a in anchors]), rtol=1e-12)
    assert {x["attended"] for x in anchor_attention(frame, listed.where("anchor < 0")).collect()} == {None}


def test_attention_does_not_shuffle_the_rows(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id", "transform(embedding, x -> cast(x as double)) AS vec")
    anchors = e.where("vec_id < 30").selectExpr("vec_id AS anchor", "vec AS avec")
    plan = anchor_attention(e, anchors, block=10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange")


def test_unscored_truths_are_reported(spark):
    scores = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7), (2, 0, 1.0), (2, 1, 0.0)], "id long, cls long, score double")
    labels = spark.createDataFrame([(1, 0), (2, 5), (3, 0)], "id long, label long")
    assert {r["id"]: r["rank"] for r in metrics.truth_rank(scores, labels).collect()} == {1: 2, 2: None, 3: None}
    got = metrics.cross_entropy(scores, labels).first()
    assert got["unscored"] == 2 and got["cross_entropy"] == pytest.approx(math.log(math.exp(0.5) + math.exp(0.7)) - 0.5)
