"""Keyed permutations, and negatives that queries draw independently."""
import random

import pytest
from pyspark.sql import functions as F

from routelens.operators import search
from routelens.operators.permutation import domain, place_of, round_keys


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 1025])
def test_each_key_permutes_all_places(spark, n):
    qs = spark.range(5).select(F.col("id").alias("qid"), F.lit(n).cast("long").alias("t")).withColumn("keys", round_keys(4, "qid"))
    size = qs.select(domain(F.col("t"))).first()[0]
    assert n <= size < n + n ** 0.5 + 1
    steps = qs.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), domain(F.col("t")) - 1)))
    orders = {}
    for r in steps.withColumn("place", place_of("step", "t", "keys")).collect():
        orders.setdefault(r["qid"], {})[r["step"]] = r["place"]
    assert all(sorted(o.values()) == list(range(size)) for o in orders.values())
    if n >= 97:
        assert len({tuple(o[i] for i in range(20)) for o in orders.values()}) == 5


def test_queries_draw_independently(spark):
    """The share of two queries' negatives that are the same is near M / n for every pair, and no item is favoured."""
    rng = random.Random(3)
    items = spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(2000)], "item long, vec array<double>").repartition(6)
    qs = items.where("item < 40").select(F.col("item").alias("qid"), "vec")
    taken, seen = {}, [0] * 2000
    for r in search.sample_negatives(qs, items, 500, seed=11).collect():
        taken.setdefault(r["qid"], {})[r["neg_idx"]] = r["item"]
        seen[r["item"]] += 1
    sets = {q: set(o.values()) for q, o in taken.items()}
    assert all(len(s) == 500 for s in sets.values())
    shared = [len(sets[a] & sets[b]) / 500 for a in sets for b in sets if a < b]
    assert 0.24 < sum(shared) / len(shared) < 0.26 and min(shared) > 0.16 and max(shared) < 0.34       # 0.25, six deviations
    mean = sum(seen) / 2000                                    # 10 of 40; a binomial's variance is 7.5
    assert 6 < sum((s - mean) ** 2 for s in seen) / 2000 < 9
    firsts = [o[1] for o in taken.values()]
    assert len(set(firsts)) > 35 and abs(sum(firsts) / 40 - 1000) < 300
    half = search.sample_negatives(qs, items, 250, seed=11).collect()
    assert all(taken[r["qid"]][r["neg_idx"]] == r["item"] for r in half)     # fewer are the first of more
    other = {(r["qid"], r["item"]) for r in search.sample_negatives(qs, items, 500, seed=12).collect()}
    assert 0.2 < sum(i in sets[q] for q, i in other) / len(other) < 0.3
