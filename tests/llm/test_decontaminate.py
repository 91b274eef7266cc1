"""Operator 3 against all windows of all documents."""
import random
from collections import Counter

from routelens.llm.op3_decontaminate import Items, benchmark_matches, drop_contaminated, shingles, weighted_similarity

WORDS = [f"w{i}" for i in range(300)]


def by_hand(docs, items, words=5, limit=0.8):
    out = set()
    for d, text in docs:
        for i, item in items:
            want = shingles(item or "", words)
            if not want:
                continue
            length = min(words, len(want[0].split()))
            names = shingles(text or "", length)
            size = len(want)
            if names and len(names[0].split()) == length and max(
                    weighted_similarity(Counter(want), Counter(names[s:s + size])) for s in range(max(1, len(names) - size + 1))) >= limit:
                out.add((d, i))
    return out


def planted():
    rng = random.Random(4)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, text(rng.choice([1, 3, 5, 8, 30, 60, 61, 90]))) for i in range(30)] + [(40, ["w1"] * 30), (41, []), (42, ["w1", "w2"] * 20)]
    docs = []
    for d in range(80):
        body = text(rng.choice([2, 10, 100, 300]))
        i, item = rng.choice(items)
        piece = list(item)
        for _ in range(rng.randrange(4)):
            if piece:
                k = rng.randrange(len(piece))
                piece[k:k + 1] = rng.choice([[], ["new"], [piece[k], "new"]])
        if d % 3:
            at = rng.randrange(len(body) + 1)
            body[at:at] = piece
        docs.append((d, rng.choice([" ", "\n", ", "]).join(body).upper() if d % 5 == 0 else " ".join(body)))
    return docs, [(i, " ".join(w)) for i, w in items]


def test_as_all_windows(spark, make):
    docs, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = benchmark_matches(make(docs), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == by_hand(docs, items)
    clean = {r["doc_id"] for r in drop_contaminated(make(docs), bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in by_hand(docs, items)}


def test_blocks_of_items(spark, make, monkeypatch):
    from routelens.llm import op3_decontaminate as op3
    docs, items = planted()
    monkeypatch.setattr(op3, "BLOCK_ITEMS", 16)
    got = benchmark_matches(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(by_hand(docs, items))


def test_odd_rows(spark, make):
    item = " ".join(WORDS[:20])
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item + " x"), (3, "")], "item_id long, text string")
    docs = make([(1, None), (2, ""), (3, item), (3, item), (None, "a " + item), (4, "word " * 50000 + item + " word" * 50000)])
    got = sorted(((r["doc_id"], r["item_id"]) for r in benchmark_matches(docs, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (3, 3, None, 4) for i in (1, None)], key=str)
    assert benchmark_matches(make([]), bench).count() == 0
    assert benchmark_matches(docs, bench.limit(0)).count() == 0
    kept = drop_contaminated(docs, bench)
    # every row goes by its own text, one with a null id too
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 2]


def test_best_window():
    items = Items([(7, " ".join(WORDS[:30]))], 5)
    got = items.matches("x " * 10 + " ".join(WORDS[:30]) + " y" * 10, 0.8)
    assert [(g[0], g[1], g[2], g[3], g[4]) for g in got] == [(7, 10, 30, 1.0, 0)]


def test_items_and_windows_with_repeated_shingles():
    """Runs of one word weigh with their square in a fingerprint; no pair at the limit is lost, whatever the run."""
    import random
    from collections import Counter

    from routelens.llm.op3_decontaminate import Items, shingles, weighted_similarity
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    found = total = 0
    for distinct, run in ((100, 8), (200, 20), (400, 45), (30, 0)):
        for case in range(12):
            body, other = [word() for _ in range(distinct)], word()
            item = " ".join([*body, *[word()] * run] if case % 2 else [*body, *[word() for _ in range(run)]])
            text = " ".join([word() for _ in range(20)] + body + [other] * run + [word() for _ in range(20)])
            items = Items([(7, item)], 5)
            names, bag = shingles(text, 5), Counter(shingles(item, 5))
            n = bag.total()
            sims = [weighted_similarity(bag, Counter(names[s:s + n])) for s in range(max(1, len(names) - n + 1))]
            got = items.matches(text, 0.8)
            assert [round(g[3], 12) for g in got] == ([round(max(sims), 12)] if max(sims) >= 0.8 else [])
            found, total = found + len(got), total + 1
            if got:
                assert got[0][1] == sims.index(max(sims))
    assert found > total / 2
