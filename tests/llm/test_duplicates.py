"""Operators 4 and 6 against brute force."""
import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from routelens.llm import op6_exact_dedup as radix
from routelens.llm.components import components
from routelens.llm.op4_simhash import drop_near_duplicates, index_triples, near_duplicates, near_links, simhash
from routelens.llm.op6_exact_dedup import drop_duplicates, exact_dedup

from .conftest import ODD


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def copies(rng):
    """Texts that share beginnings of many lengths, with copies."""
    base = "".join(rng.choice("abcD é") for _ in range(20000))
    rows = []
    for i in range(60):
        n = rng.choice([1, 63, 64, 65, 1000, 1024, 1025, 16383, 16384, 16385, 20000])
        t = base[:n]
        if rng.random() < 0.4:
            t = t[:-1] + rng.choice("xyz")
        rows.append((i, t.upper() if rng.random() < 0.2 else t))
    return rows


@pytest.mark.parametrize("rows", [ODD, copies(random.Random(5)), []], ids=["odd", "shared beginnings", "empty"])
def test_exact(make, rows):
    assert sorted(map(tuple, exact_dedup(make(rows)).collect()), key=str) == exact_by_hand([r[:2] for r in rows])


def test_exact_with_short_runs(make, monkeypatch):
    monkeypatch.setattr(radix, "FIRST_BYTES", 1)
    monkeypatch.setattr(radix, "GROWTH", 2)
    rows = [(i, t) for i, t in enumerate(["abcdefgh", "abcdefgx", "ABCDEFGH", "ab", "aB", "", None, "abcdefghabcdefgh", "abcdefghabcdefgh", "é", "É"])]
    assert sorted(map(tuple, exact_dedup(make(rows)).collect()), key=str) == exact_by_hand(rows)


def test_drop_duplicates_keeps_columns(make):
    docs = make(ODD)
    kept = drop_duplicates(docs)
    assert kept.columns == docs.columns
    gone = {i for i, _, _, k, _ in exact_by_hand(ODD) if not k and i is not None}
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(i or -1 for i, _ in ODD if i not in gone)


ROWS = [(1, "one two three"), (1, "one two three"), (None, "ONE two three"), (None, "four five six"), (None, "four five six"), (2, "seven eight nine"), (3, "Seven eight nine"),
        (2, "ten eleven twelve"), (None, None), (None, ""), (4, "alone")]


def test_one_row_of_each_group_stays(spark, make, tmp_path):
    """With null and repeated ids, whether the table is read from Parquet or made by a plan."""
    make(ROWS).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for stage, best in ((corpus_pipeline.exact, 3), (corpus_pipeline.near, 2)):
        keep = lambda docs: stage(spark, docs, "")  # noqa: E731, B023
        for table in (make(ROWS), docs, docs.where("source <> ''"), docs.unionByName(docs)):
            kept = keep(table)
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
            got = sorted((lower(r["text"]), r["doc_id"]) for r in kept.collect() if r["text"])
            assert got == [("alone", 4), ("four five six", None), ("one two three", 1), ("seven eight nine", best), ("ten eleven twelve", 2)]
            assert kept.count() == 6
        assert keep(docs.limit(0)).count() == 0


def fingerprint(text, words=4):
    parts = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    names = [" ".join(parts[k:k + words]) for k in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in names]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def near_by_hand(rows, distance=4):
    fp = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= distance:
            root[find(j)] = find(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f"{fp[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def test_triples_cover():
    triples = index_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_simhash_over_blocks(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "B", "cé", "d"]) for _ in range(n)) for n in (0, 1, 3, 4, 5, 50, 3000)] + ["x"] * 2
    assert [int(x) for x in simhash([t.encode() for t in texts], 4)] == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_near(make, rows):
    assert sorted(map(tuple, near_duplicates(make(rows)).collect()), key=str) == near_by_hand(rows)


def test_near_copies(make):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(120):
        text = [words[(i % 6) * 40 + k] for k in range(40)] * 2
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    got = sorted(map(tuple, near_duplicates(make(rows)).collect()), key=str)
    assert got == near_by_hand(rows)
    kept = {r["doc_id"] for r in drop_near_duplicates(make(rows)).collect()}
    assert kept == {c for _, _, c in got}


def test_links_of_any_fingerprints(spark):
    """Chains, stars and random neighbours of given fingerprints, linked as by all pairs."""
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(12):
            for _ in range(rng.randrange(1, 6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got = {r["node"]: r["root"] for r in near_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4), 4).collect()}
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {f: got.get(f, f) for f in signed} == {f: find(f) for f in signed}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 300), (201, 200), (200, 201), (500, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 500: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
