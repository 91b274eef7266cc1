import re
import random
from hashlib import sha256

import pytest

from routelens.llm.op13_pii import KINDS, find_pii, pattern_posteriors, pii_spans

from .conftest import ODD


def luhn(digits):
    twice = lambda v: v * 2 - 9 * (v > 4)
    return sum(twice(int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    """The contract's rules in plain Python."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
             (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
             (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m))


def spell(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def compare(docs):
    texts = [r[0] or "" for r in docs.select("text").collect()]
    rows = pii_spans(docs).collect()
    assert len(rows) == len(texts)
    want = sorted((sha256(spell(b := base_spans(t)).encode()).hexdigest(), *(sum(k == i for _, k, _ in b) for i in range(4))) for t in texts)
    assert sorted((r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows) == want
    return rows


def test_base_spans_by_hand(make):
    docs = make([(1, "a@b.c_d@e.f a@b@c.d x@y a.b@c-.d-e.f. \U0001f600 q@r.st"), (2, "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.1.1.99999 0000.0.0.0"),
                 (3, "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 42424242 4242 4242 42 0000000000000000000 12 3"),
                 (4, "+1 (269) 555-3296 +1 (269) 555-32 +12345678 +123456789 +1.2.3.4 ((.-5 +1234567890123456 +1(2) +4917612345678"),
                 (5, "é" * 5 + "mail é.x@mail.example.com +1 555 555 5555 4111111111111111"), *ODD])
    compare(docs)


def test_base_spans_of_random_strings(make):
    r = random.Random(5)
    pieces = ["@", ".", "-", " ", "+", "(", ")", "1", "25", "4111111111111111", "a", "b.c", "_", "\n", "é", "\U0001f600", "%", "192.168.1.1", "+1 269 555 3296"]
    compare(make([(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 60)))) for i in range(400)]))


def test_long_runs_take_neither_stack_nor_square_time(make):
    runs = lambda n: ["x" * n, "1" * n, "1 " * n, "a." * n + "@b" + ".c" * n, "+" + "1 " * n, "1.2.3.4" * (n // 8), "Ab " * n, "jo@x.org " * (n // 8)]
    compare(make(list(enumerate(runs(1000)))))
    rows = {r["doc_id"]: r for r in pii_spans(make(list(enumerate(runs(200_000))))).collect()}
    assert [rows[i]["n_email"] for i in range(8)] == [0, 0, 0, 1, 0, 0, 0, 25_000]
    assert [rows[i]["n_card"] + rows[i]["n_phone"] for i in range(8)] == [0] * 8
    assert rows[5]["n_ip"] == len(re.findall(r"[0-9]+(?:\.[0-9]+){3}", "1.2.3.4" * 25_000))


def test_whole_table(spark):
    compare(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_posteriors_find_the_reliable_labelers():
    r, counts = random.Random(3), {}
    right = [0.95, 0.9, 0.85, 0.9, 0.6, 0.8]
    classes = {}
    for _ in range(20000):
        c = r.random() < 0.3
        v = "".join(("+" if (r.random() < p) == c else "0" if i == 1 else "-") for i, p in enumerate(right))
        counts[0, v] = counts.get((0, v), 0) + 1
        classes.setdefault(v, []).append(c)
    post = pattern_posteriors(counts)
    wrong = sum((post[0, v] > 0.5) != c for v, cs in classes.items() for c in cs)
    assert wrong < 0.04 * 20000
    assert pattern_posteriors({}) == {}
    assert pattern_posteriors({(2, "+-++0+"): 100, (2, "+++00+"): 5})[2, "+-++0+"] == 0.0


def test_added_spans(make):
    """Wider forms beside cues are added; failed checksums, numbers that are something else, and common text aren't."""
    texts = [f"Please call {200 + i} 555-{1000 + i} or write to jo{i} (at) site{i} (dot) org today." for i in range(60)]
    texts += [f"My name is Maria Lopez{'abcdefgh'[i % 8]} and I signed." for i in range(40)]
    texts += [f"The Old River ran on, in New Town, by Great Hall. Serial 4111-1111-1111-{1000 + i}, order 12345678901{i % 10}." for i in range(60)]
    docs = make(list(enumerate(texts)))
    added = {r["doc_id"]: [(KINDS[s["kind"]], texts[r["doc_id"]][s["start"]:s["end"]]) for s in r["added"]] for r in find_pii(docs).collect()}
    for i in range(60):
        assert ("phone", f"{200 + i} 555-{1000 + i}") in added[i]
        assert ("email", f"jo{i} (at) site{i} (dot) org") in added[i]
    named = sum(any(k == "name" for k, _ in added[i]) for i in range(60, 100))
    assert named >= 36
    assert not any(added[i] for i in range(100, 160))
    rows = {r["doc_id"]: r for r in pii_spans(docs).collect()}
    assert rows[0]["spans"] == "phone:12:24,email:37:55" or "phone:12:24" in rows[0]["spans"]


def test_empty_table_and_no_python_in_the_plan(make, spark):
    from routelens.session import drop_tables
    assert pii_spans(make([(1, "x")]).where("doc_id > 1")).collect() == []
    plan = pii_spans(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    drop_tables(spark)


if __name__ == "__main__":
    pytest.main([__file__])
