"""Approximate search by the inverted file: recall with the query's own parameters, hot lists, odd rows."""
import random

import pytest
from pyspark.sql import functions as F

from routelens.operators import search
from routelens.operators.ivf import ann_topk, build_index
from routelens.plans.registry import ANN, QUERIES


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_of_the_registered_query(spark, sf):
    d = f"/root/testdata/sf{sf}"
    got = QUERIES["ann_search"](spark, d).collect()
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("item"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    qs = e.where("item % 50 = 0").select(F.col("item").alias("qid"), "vec")
    exact = {(r.qid, r.item) for r in search.vector_topk(qs, e, ANN["k"]).collect()}
    assert len({r.qid for r in got}) == qs.count()
    assert len(exact & {(r.qid, r.item) for r in got}) >= 0.9 * len(exact)
    ranks = {}
    for r in got:
        ranks.setdefault(r.qid, []).append((r.rank, r.dist, r.item))
    for rows in ranks.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(len(rows))) and all(a[1:] <= b[1:] for a, b in zip(rows, rows[1:]))


def _vectors(spark, n, hot):
    r = random.Random(6)
    rows = [(i, [r.gauss(i % 7, 1) for _ in range(8)]) for i in range(n)] + [(n + i, [0.5] * 8) for i in range(hot)]
    return spark.createDataFrame(rows, "item long, vec array<double>").repartition(6), rows


def test_all_lists_probed_is_nearly_exact_and_parts_change_nothing(spark):
    """A vector that a third of the rows share; parts of a list and of its queries give what whole lists give."""
    items, rows = _vectors(spark, 1200, 600)
    qs = items.where("item % 9 = 0").select(F.col("item").alias("qid"), "vec")
    index = build_index(items, lists=20)
    keyed = lambda frame: sorted((r.qid, r.rank, round(r.dist, 9)) for r in frame.collect())       # of 600 equal vectors, any will do
    whole = keyed(ann_topk(qs, items, 5, probes=20, index=index))
    assert keyed(ann_topk(qs, items, 5, probes=20, index=index, list_rows=37, query_rows=11)) == whole
    exact = keyed(search.vector_topk(qs, items, 5))
    assert len(set(whole) & set(exact)) >= 0.97 * len(exact)


def test_every_item_is_indexed_once(spark):
    items, rows = _vectors(spark, 500, 100)
    index = build_index(items, lists=9, sample=50)                     # fitted on a few, dealt all
    assert sorted(r["item"] for r in index.codes.select("item").collect()) == [i for i, _ in rows]
    assert all(len(r["code"]) == 8 for r in index.codes.collect())


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0, 2.0]), (6, [3.0, 0.0])]
    items = spark.createDataFrame(rows, "item long, vec array<double>")
    qs = items.select(F.col("item").alias("qid"), "vec")
    got = {(r.qid, r.rank, r.item) for r in ann_topk(qs, items, 2, lists=2, probes=2).collect()}
    assert got == {(1, 0, 1), (1, 1, 5), (5, 0, 1), (5, 1, 5), (6, 0, 6), (6, 1, 1)}
    assert ann_topk(qs, items.where("item = 2"), 3).collect() == []
    with pytest.raises(Exception, match="different length"):
        ann_topk(qs, items.unionByName(spark.createDataFrame([(7, [1.0])], items.schema)), 2, lists=1).collect()
