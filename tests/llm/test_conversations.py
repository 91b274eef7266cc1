import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from hashlib import sha256
from itertools import product

import pytest

from routelens.llm.op11_conversations import FIELDS, PARSER, conversation_repair, repair


def cheapest(tokens):
    """(cost, audit) by plain search over the contract's edits: state is the role string's shape."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(tokens) and state in ("", "a") else []
        options = []
        if i < len(tokens):
            initial, fault = tokens[i]
            options.append((3, "D", i + 1, state, 0))
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                options += [(extra, "K", i + 1, step.get((state, initial)), 0)] + [(2 + extra, "R", i + 1, step.get((state, t)), 0) for t in "ua"]
        if inserted < 3:
            options += [(2, "I", i, step.get((state, t)), inserted + 1) for t in "ua"]
        for cost, edit, j, to, k in options:
            if to is not None and (rest := best(j, to, k)):
                found.append((cost + rest[0], edit + rest[1]))
        return min(found) if found else None

    return best(0, "", 0)


def brute(rows):
    out, groups = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            groups[conv] += [row] * (1 + (kind == 3))
    for conv, rows_ in groups.items():
        rows_ = sorted(rows_, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in rows_:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows_]
        cost, audit = cheapest(list(zip(initials, faults)))
        lines, at, before = [], iter(rows_), ""
        for edit in audit:
            _, role, text = next(at) if edit != "I" else (0, "", "")
            if edit != "D":
                if edit != "K":
                    role = "assistant" if before == "u" else "user"
                before = role[0]
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = {r[0] for r in rows_} - {None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def compare(spark, rows, long):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, gone string, no long").repartition(3)
    found = [tuple(r) for r in conversation_repair(docs, long).select("conv_id", *FIELDS).collect()]
    assert {r[0]: r[1:] for r in found} == brute(rows)
    assert len(found) == len({r[0] for r in rows})


def test_parser_accepts_the_grammar():
    for n in range(7):
        for roles in product("sua", repeat=n):
            stack = (0,)
            for t in roles:
                stack = stack and PARSER.shift(stack, t)
            assert bool(stack and PARSER.accepts(stack)) == bool(re.fullmatch("(s?(ua)+)?", "".join(roles)))


def test_parser_finds_the_least_cost_and_audit():
    kinds = [*product("sua ", ["", "truncated"]), ("u", "blank"), ("", "")]
    r = random.Random(2)
    cases = [list(c) for n in range(4) for c in product(kinds, repeat=n)] + [[r.choice(kinds) for _ in range(r.randint(4, 12))] for _ in range(300)]
    for rows in cases:
        assert PARSER.accepted(PARSER.parse(rows)) == cheapest(rows), rows


def test_hand_case():
    assert repair([]) == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": sha256(b"").hexdigest()}
    out = repair([(0, "assistant", "Hi."), (3, "user", "So?"), (4, "user", " "), (5, "tool", "x")])
    assert (out["gaps"], out["blank"], out["truncated"], out["illegal"], out["cost"], out["audit"]) == (2, 1, 1, 2, *cheapest([("a", ""), ("u", ""), ("u", "blank"), ("t", "truncated")]))


def odd(r, n, convs):
    texts = ["Hi.", "Yes!", "no", "", " \n", None, "same.", "é?", "end. \t", "a\nb.", "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "u"]
    return [(r.choice([*range(convs), None]), r.choice([*range(12), None, -5]), r.choice(roles), r.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("long", [10_000, 3])
def test_odd_rows_against_brute_force(spark, long):
    rows = odd(random.Random(4), 400, 50)
    compare(spark, rows + rows[:20], long)


def test_one_conversation_with_most_rows(spark):
    """Cut into pieces, with rows that repeat across them."""
    r = random.Random(9)
    rows = [(7, i // 2, r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice([f"t{i}.", f"t{i % 900}.", "same."])) for i in range(9000)]
    docs = spark.createDataFrame(rows + odd(r, 60, 6), "conv_id long, turn long, role string, text string").repartition(5)
    keyed = lambda frame: {x["conv_id"]: tuple(x[f] for f in FIELDS) for x in frame.collect()}
    cut, whole = keyed(conversation_repair(docs, 50)), keyed(conversation_repair(docs))
    assert cut == whole and len(whole[7][FIELDS.index("audit")]) > 7000


def test_given_conversations_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(x) for x in docs.select("conv_id", "turn", "role", "text").collect()]
    assert {x["conv_id"]: tuple(x[f] for f in FIELDS) for x in conversation_repair(docs).collect()} == brute(rows)
    assert conversation_repair(docs.where("turn > 99")).collect() == []
