import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from routelens.llm import op12_divergence
from routelens.llm.op12_divergence import oracle, source_divergence

from .conftest import ODD


def brute(rows, min_docs, top):
    """rows of (lang, source, text)."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        sources[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in names}
        q = shares(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in names if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(sorted(found)[:most], 1)}
    return out


def result(frame):
    rows = [tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    words = ["the", "of", "éa", "Éa", "word", "漢字", "it's", "a1b", "x_y", "ÀB", "straße", "İ"] + ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["s0", "s0", "s0", "s1", "é2", None]), " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for _ in range(300)]
    return rows + [("fr", "only", "un deux"), ("xx", "a", ""), ("xx", "b", None), ("en", "empty", None), (None, None, None)] + [("en", "s0", "same same text")] * 20


def frame_of(spark, rows):
    docs = [(i, *r, "x", "y") for i, r in enumerate(rows)]
    return spark.createDataFrame(docs, "doc_id long, lang string, source string, text string, digest string, n string").repartition(3)


@pytest.mark.parametrize("bits", [64, 5, 1])
def test_against_brute_force_also_where_digests_collide(spark, corpus, bits):
    assert result(source_divergence(frame_of(spark, corpus), 10, 8, digest_bits=bits)) == brute(corpus, 10, 8)


def test_small_blocks_tiles_and_held_rows(spark, corpus, monkeypatch):
    for name, value in (("CELLS", 40), ("LEAST_TERMS", 3), ("TILE", 2), ("HELD", 20), ("DIGESTS", 1)):
        monkeypatch.setattr(op12_divergence, name, value)
    assert result(source_divergence(frame_of(spark, corpus), 3, 5, digest_bits=7)) == brute(corpus, 3, 5)


def test_odd_rows_and_empty_table(spark, make):
    docs = make(ODD)
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    assert result(source_divergence(docs, 1, 50)) == brute(rows, 1, 50)
    assert result(source_divergence(docs.where("doc_id > 99"), 1, 50)) == set()


def test_given_documents_against_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert result(source_divergence(docs)) == set(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({oracle()})").fetchall())
