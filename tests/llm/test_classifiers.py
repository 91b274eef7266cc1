"""Operators 5, 8 and 9: held-out accuracy, folds and odd rows."""
import random
import zlib

import numpy as np
import pytest

from routelens.llm.op5_language import language_id, presence
from routelens.llm.op8_quality import drop_low_quality, pool_adjacent, quality_scores, statistics, N_STATISTICS
from routelens.llm.op9_toxicity import all_places, places, solve, swapped, toxicity_scores

from .conftest import ODD

D = "/root/testdata/sf0.1"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def joined(scores, truth):
    return [(r, truth[r["doc_id"]]) for r in scores if r["doc_id"] in truth]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")


def test_language(tables):
    docs, _ = tables
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language_id(docs).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows) and len(rows) == len(truth)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.99


def test_language_learns_only_from_its_folds(spark, make):
    rng = random.Random(0)
    words = {"aa": ["kala", "mela", "lak"], "bb": ["zoru", "ruzz", "uzo"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    rows = [(i, t, ("bb" if k == "aa" else "aa") if fold(i, 4) == 2 else k) for i, t, k in rows]     # held-out labels are wrong
    got = {r["doc_id"]: r["lang_pred"] for r in language_id(make(rows)).collect()}
    assert all(got[i] == ("aa", "bb")[i % 2] for i, _, _ in rows)


def test_language_odd_rows(make):
    rows = [(i, t, "en") for i, t in ODD] + [(100, "123 !", "en"), (101, "hello there", None)]
    got = sorted(map(tuple, language_id(make(rows)).collect()), key=str)
    assert len(got) == len(rows)
    assert {r[2] for r in got if r[0] in (1, 2, 3, 100)} == {"und"} and {r[2] for r in got if r[0] in (4, 8, 101)} == {"en"}
    assert language_id(make([])).count() == 0
    assert {r["lang_pred"] for r in language_id(make([(1, "abc", None)])).collect()} == {"und"}


def test_quality(tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality_scores(docs, labels).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r["predicted"] == y for r, y in joined(rows, truth) if r["held_out"]]
    assert len(held) > 300 and np.mean(held) > 0.97


def test_quality_odd_rows(spark, make):
    labels = spark.createDataFrame([(6, 0), (7, 0), (8, 1), (8, 1), (4, None), (None, 1), (99, 1)], "doc_id long, quality int")
    docs = make(ODD)
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(make([]), labels).count() == 0
    assert drop_low_quality(docs, labels).columns == docs.columns
    one = quality_scores(docs, spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")).collect()
    assert all(r["score"] > 0.9 for r in one)


def test_statistics_are_finite():
    for _, t in ODD:
        x = statistics((t or "").encode())
        assert len(x) == N_STATISTICS and np.isfinite(x).all()


def test_isotonic():
    got = pool_adjacent(np.array([0.0, 2, 1, 3]), np.array([1.0, 2, 2, 3]))
    assert got.tolist() == [0, 0.75, 0.75, 1]


def test_toxicity(tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity_scores(docs, labels).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], y) for r, y in joined(rows, truth) if r["held_out"]]
    assert np.mean([p for p, y in held if y]) > 0.8 and np.mean([p for p, y in held if not y]) < 0.01


def test_neutral_mentions_stay_neutral(spark, make):
    """Insults go with one group in the labels; a neutral mention of the group still isn't toxic."""
    rng = random.Random(1)
    filler = ["walk", "house", "river", "green", "stone", "cloud", "paper", "music"]
    line = lambda *more: " ".join(rng.sample([rng.choice(filler) for _ in range(12)] + list(more), 12 + len(more)))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        rows.append((i, line("muslims", *(["scumbag"] if i % 2 else ["vermin"])) if toxic else line("christians" if i % 2 else "jews")))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, line(t)) for i, t in enumerate(["muslims", "christians", "jews", "hindus"] * 5)]
    rows += [(2000 + i, line("christians", "scumbag")) for i in range(5)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity_scores(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert not any(got[1000 + i] for i in range(20)) and all(got[2000 + i] for i in range(5))


def test_swap_penalty_is_what_does_it():
    rows = [(1.0, 1.0, np.array([0, 1])), (0.0, 1.0, np.array([2]))] * 50
    free, _ = solve(rows, [], 3)
    held, _ = solve(rows, [(np.array([0]), np.array([2]))], 3)
    assert free[0] - free[2] > 3 and abs(held[0] - held[2]) < 0.5 < held[1]


def test_swapped():
    assert swapped("The Women and christians came") == "The men and muslims came"
    assert swapped("swomen nothing") is None


def test_toxicity_odd_rows(spark, make):
    labels = spark.createDataFrame([(6, 0), (7, 1), (8, 0), (9, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity_scores(make(ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["predicted"] for r in toxicity_scores(make(ODD), labels.limit(0)).collect()} == {0}
    assert toxicity_scores(make([]), labels).count() == 0
    assert len(places("")) == 0 and len(all_places("ab")) and len(presence("1 2")) == 0
