"""The recovery objective against plain Python; the encoder hook's batches, set-ups and plan."""
import glob
import math
import os
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelens.operators import recovery
from routelens.operators.vectors import encode_trips, length_batches, summary_encoder


def _entropy(rows, classes, strength):
    train = [r for r in rows if r[0] == 0 and r[4] is not None]
    prior, total = Counter(r[4] for r in train), []
    for s, a, b, c, y in rows:
        if s != 2 or y is None:
            continue
        p = (prior[y] + 1) / (len(train) + classes)
        for i, ctx in (((2, 3), (b, c)), ((1,), (a,))):
            same = [r[4] for r in train if None not in ctx and tuple(r[j] for j in i) == ctx]
            p = (same.count(y) + strength * p) / (len(same) + strength)
        total.append(-math.log(p))
    return sum(total) / len(total), len(total)


@pytest.mark.parametrize("classes", [None, 12])
def test_backoff_entropy(spark, classes):
    r = random.Random(5)
    some = lambda n: None if r.random() < 0.1 else r.randrange(n)
    rows = [(r.randrange(3), some(6), some(3), some(2), some(9)) for _ in range(600)]
    df = spark.createDataFrame(rows, "split int, a int, b int, c int, y int").repartition(4)
    args = ("y", [("a",), ("b", "c")], F.col("split") == 0, F.col("split") == 2, classes, 2.0)
    got = recovery.backoff_cross_entropy(df, *args).first()
    seen = len({x[4] for x in rows if x[4] is not None}) + 1
    want = _entropy(rows, classes or seen, 2.0)
    assert got["n"] == want[1] and abs(got["loss"] - want[0]) < 1e-12
    assert tuple(recovery.backoff_cross_entropy(df.limit(0), *args).first()) == (None, 0)


def test_ridge(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    y = np.stack([x @ [1.0, -2.0, 0.5] + 3 + r.normal(size=400) * 0.1, x[:, 0] * 0 - 1], 1)
    rows = [(*map(float, a), *map(float, b)) for a, b in zip(x, y)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, float("nan"), 1.0)], "a double, b double, c double, y double, z double")
    full = np.hstack([np.ones((400, 1)), x])
    want = np.linalg.solve(full.T @ full + 2.0 * np.diag([0, 1, 1, 1]), full.T @ y)
    got = recovery.ridge_fit(df, ["a", "b", "c"], ["y", "z"], 2.0)
    assert np.allclose(got, want, atol=1e-10)
    errors = {e["feature"]: (e["loss"], e["n"]) for e in recovery.ridge_errors(df, ["a", "b", "c"], ["y", "z"], got).collect()}
    for j, t in enumerate("yz"):
        assert errors[t][1] == 400 and abs(errors[t][0] - ((full @ want - y)[:, j] ** 2).mean()) < 1e-10
    assert not recovery.ridge_fit(df.limit(0), ["a"], ["y"]).any()


def test_objective_total(spark):
    part = lambda v: spark.createDataFrame([("f", v, 4)], "feature string, loss double, n long")
    total = lambda *v: recovery.objective([("k", 0.5, part(x)) for x in v]).where("kind = 'total'").first()["loss"]
    assert total(1.0, 3.0) == 2.0 and total(1.0, None) is None


def test_length_batches():
    lengths = np.array(random.Random(2).choices(range(0, 120), k=1000))
    parts = length_batches(lengths, 8, 50)
    assert sorted(np.concatenate(parts)) == list(range(1000)) and max(map(len, parts)) <= 50
    assert all(lengths[p].max() - lengths[p].min() < 8 for p in parts)


def test_encoder_hook(spark, tmp_path):
    """Any keys, no shuffle, one set-up in a worker, the same vectors as trip by trip."""
    r = random.Random(4)
    trips = [(f"t{i}", i % 3, [(r.random(), r.random()) for _ in range(r.randint(1, 60))]) for i in range(400)]
    rows = spark.createDataFrame([*trips, ("none", 0, None), ("empty", 1, [])], "name string, split int, pts array<struct<a:double,b:double>>").repartition(8)
    folder = str(tmp_path)

    def setup():
        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return summary_encoder

    coded = encode_trips(rows, ["a", "b"], setup, 8, keys=("name", "split"))
    got = {x["name"]: x for x in coded.collect()}
    assert len(got) == 402 and got["none"]["vec"] is None and got["empty"]["vec"] is None
    for name, s, pts in trips:
        a = np.array(pts)
        assert got[name]["split"] == s and np.allclose(got[name]["vec"], np.concatenate([a.mean(0), a.std(0), a[0], a[-1]]))
    pids = [os.path.basename(f).split("-")[0] for f in glob.glob(f"{folder}/*")]
    assert pids and len(pids) == len(set(pids))


def test_encoder_plan_has_no_exchange(ds_small):
    coded = encode_trips(ds_small.feature_rows, ["lng", "lat"], lambda: summary_encoder, 8)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
