"""Operator 11: repair of conversation structure by generalised LR parsing.

A conversation's roles have to follow the grammar of ``GRAMMAR``: nothing, or
an optional system turn and then user and assistant in turns. Each row can be
kept, given another role, or deleted, and empty rows can be inserted anywhere,
each at a cost. The parser reads the rows with a graph-structured stack: each
row's edits shift or skip its role from every stack top (reductions by the
grammar's SLR table come first), insertions are followed until nothing gets
cheaper, and equal stack tops are merged by the least (cost, audit). The audit
is the string of the edits' initials: K, R, D, I. Merging is safe, as equal
tops take the same continuations, and an audit of the same cost for the same
rows is never the beginning of another.

Rows of a conversation go by turn (nulls first), then role, text; rows equal in
all of these are alike. A conversation of up to ``long`` rows is read by one
task from a sorted shuffle, one conversation at a time. The rows of longer ones
are range partitioned by their order, numbered, and cut into pieces of at most
2^PIECE_BITS; first occurrences are a minimum over digests (SHA-256 of role and
text); each piece is parsed from every stack that can lie under it, the pieces'
results are chained in order (a piece has at most a few dozen short rows), and
the texts are rebuilt piece by piece. Only the final digest, which is
sequential, reads a conversation's rebuilt pieces in one task, as a stream.

Null role and text are one space, null ids and turns too in the damage rule;
rows of null ids form one conversation. A role's initial is its first
character; an empty role has none, so it can't be kept and is illegal beside
any other. Every original id gives a row. Without rows after the damage all
numbers are 0. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .common import cut_lineage, prepare, slices

#: Conversation, turns: s, u and a are the roles' initials.
GRAMMAR = (("S", "C"), ("C", ""), ("C", "T"), ("C", "sT"), ("T", "ua"), ("T", "Tua"))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset({"su", "ua", "au"})
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
LONG = 20_000
PIECE_BITS = 11

Item = tuple[int, int]                                          # production, place of the dot
Stack = tuple[int, ...]                                         # LR states from the bottom to the top
Best = dict[int, tuple[int, str, Stack]]                        # by stack top: cost, audit, stack


class Parser:
    """SLR table of a grammar and the moves of its stacks, each found once."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR) -> None:
        self.grammar = grammar
        self.heads = {h for h, _ in grammar}
        self.follow = self._follow()
        self.states = [self._closure({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for i, state in enumerate(self.states):                 # grows while new states turn up
            for symbol in sorted({self._next(x) for x in state} - {""}):
                kernel = self._closure({(p, d + 1) for p, d in state if self._next((p, d)) == symbol})
                if kernel not in self.states:
                    self.states.append(kernel)
                self.goto[i, symbol] = self.states.index(kernel)
        self.moves: dict[tuple[Stack, str], Stack | None] = {}
        self.stacks: list[Stack] = [(0,)]
        for stack in self.stacks:
            found = [self.shift(stack, t) for t in "sua"]
            self.stacks += [s for s in dict.fromkeys(found) if s and s not in self.stacks]
        self.number = {s: i for i, s in enumerate(self.stacks)}

    def _next(self, item: Item) -> str:
        return self.grammar[item[0]][1][item[1]:item[1] + 1]

    def _closure(self, items: set[Item]) -> frozenset[Item]:
        out, todo = set(items), list(items)
        while todo:
            symbol = self._next(todo.pop())
            new = {(p, 0) for p, (h, _) in enumerate(self.grammar) if h == symbol} - out
            out |= new
            todo += new
        return frozenset(out)

    def _follow(self) -> dict[str, set[str]]:
        """Tokens (or the end) that can come after each head; the grammar's heads but the first two are never empty."""
        first: dict[str, set[str]] = {h: set() for h in self.heads}
        follow: dict[str, set[str]] = {h: set() for h in self.heads}
        follow[self.grammar[0][0]].add("$")
        for _ in range(len(self.grammar) + 1):
            for head, body in self.grammar:
                first[head] |= first.get(body[0], {body[0]}) if body else set()
                for i, symbol in enumerate(body):
                    if symbol in self.heads:
                        follow[symbol] |= first.get(body[i + 1], {body[i + 1]}) if i + 1 < len(body) else follow[head]
        return follow

    def _reduced(self, stack: Stack, token: str) -> tuple[Stack, str | None]:
        """The stack after all reductions before ``token``, symbols known by the states."""
        while True:
            found = [p for p, d in self.states[stack[-1]] if d == len(self.grammar[p][1]) and token in self.follow[self.grammar[p][0]] and p]
            if not found or (stack[-1], token) in self.goto:
                return stack, token
            head, body = self.grammar[found[0]]
            stack = stack[:len(stack) - len(body)]
            stack = (*stack, self.goto[stack[-1], head])

    def shift(self, stack: Stack, token: str) -> Stack | None:
        if (stack, token) not in self.moves:
            under, _ = self._reduced(stack, token)
            to = self.goto.get((under[-1], token))
            self.moves[stack, token] = None if to is None else (*under, to)
        return self.moves[stack, token]

    def accepts(self, stack: Stack) -> bool:
        top, _ = self._reduced(stack, "$")
        return (0, len(self.grammar[0][1])) in self.states[top[-1]]

    def inserted(self, best: Best) -> Best:
        """With insertions, until no stack top gets better."""
        todo = list(best)
        while todo:
            cost, audit, stack = best[todo.pop()]
            for token in ROLES:
                to = self.shift(stack, token)
                if to and ((new := (cost + INSERT, audit + "I", to))[:2] < best.get(to[-1], (1 << 62,))[:2]):
                    best[to[-1]] = new
                    todo.append(to[-1])
        return best

    def parse(self, rows: list[tuple[str, str]], stack: Stack = (0,)) -> Best:
        """Rows are (role's initial, fault: blank, duplicate, truncated or nothing)."""
        best = self.inserted({stack[-1]: (0, "", stack)})
        for initial, fault in rows:
            after: Best = {}

            def take(to: Stack | None, cost: int, audit: str, after: Best = after) -> None:
                if to and (cost, audit) < after.get(to[-1], (1 << 62,))[:2]:
                    after[to[-1]] = (cost, audit, to)

            more = TRUNCATED if fault == "truncated" else 0
            for cost, audit, below in best.values():
                take(below, cost + DELETE, audit + "D")
                if fault in ("", "truncated"):
                    if initial in ("s", "u", "a"):
                        take(self.shift(below, initial), cost + KEEP + more, audit + "K")
                    for token in ROLES:
                        take(self.shift(below, token), cost + REROLE + more, audit + "R")
            best = self.inserted(after)
        return best

    def accepted(self, best: Best) -> tuple[int, str]:
        return min(x[:2] for x in best.values() if self.accepts(x[2]))

    def repaired(self, rows: list[tuple[str, str]], audit: str, stack: Stack = (0,)) -> list[str]:
        """``role:text`` of the rows that an audit leaves; rows are (role, text)."""
        out, at = [], iter(rows)
        for edit in audit:
            role, text = next(at) if edit != "I" else ("", "")
            if edit == "D":
                continue
            token = role[0] if edit == "K" else next(t for t in ROLES if self.shift(stack, t))     # never both
            stack = self.shift(stack, token)
            out.append(f"{role if edit == 'K' else ROLES[token]}:{text}")
        return out


PARSER = Parser()


def fault_of(text: str, seen: bool) -> str:
    body = text.rstrip(SPACE)
    return "blank" if not body else "duplicate" if seen else "truncated" if body[-1] not in ".!?" else ""


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def repair(rows: list[tuple[int | None, str, str]]) -> dict[str, object]:
    """The result of one conversation's rows (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = PARSER.accepted(PARSER.parse(list(zip(initials, faults, strict=True))))
    text = "\n".join(PARSER.repaired([r[1:] for r in rows], audit))
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": illegal_pairs(initials), "cost": cost, "audit": audit, "repaired_sha256": sha256(text.encode()).hexdigest()}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FIELDS = [x.split()[0] for x in RESULT.split(", ")]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone) after the contract's damage; a dropped row stays as a mark (``gone``) of its conversation."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn))) % 20
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(spaced(role)).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text)).alias("text"), (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and order to a result row a conversation."""
    out: list[dict] = []
    now: list[tuple[int | None, str, str]] = []
    of: object = _whole                                         # no conversation yet

    def results(last: bool) -> Iterator[pa.RecordBatch]:
        if out and (last or len(out) >= 2000):
            columns = {name: [r[name] for r in out] for name in ("conv", *FIELDS)}
            yield pa.RecordBatch.from_arrays([pa.array(columns["conv"]) if any(c is not None for c in columns["conv"]) else pa.nulls(len(out), kind), *(
                pa.array(columns[f], pa.string() if f in ("audit", "repaired_sha256") else pa.int64()) for f in FIELDS)], names=["conv", *FIELDS])
            out.clear()

    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field("conv").type
        for part in slices(batch, "text"):
            for conv, turn, role, text, gone in zip(*(part.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone")), strict=True):
                if conv != of:
                    if of is not _whole:
                        out.append({"conv": of, **repair(now)})
                    of, now = conv, []
                    yield from results(False)
                if not gone:
                    now.append((turn, role, text))
    if of is not _whole:
        out.append({"conv": of, **repair(now)})
        yield from results(True)


def _parse_piece(rows: pd.DataFrame) -> pd.DataFrame:
    """A piece from every stack under it: a row for each pair of stacks, by number, with cost and audit."""
    rows = rows.sort_values("pos")
    initials = rows["initial"].tolist()
    tokens = list(zip(initials, rows["fault"], strict=True))
    found = [(i, PARSER.number[stack], cost, audit) for i, under in enumerate(PARSER.stacks) for cost, audit, stack in PARSER.parse(tokens, under).values()]
    return pd.DataFrame(found, columns=["start", "end", "cost", "audit"]).assign(
        no=rows["no"].iloc[0], chunk=rows["chunk"].iloc[0], inside=illegal_pairs(initials), first=initials[0], last=initials[-1])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to the stacks under each piece on the cheapest way (``chunk``, ``start``, ``end``) and, with chunk -1, the whole result."""

    def close() -> pa.RecordBatch:
        best = {PARSER.stacks[i][-1]: (c, a, PARSER.stacks[i]) for i, (c, a) in state.items()}
        cost, audit = PARSER.accepted(best)
        at = next(i for i, x in state.items() if x == (cost, audit) and PARSER.accepts(PARSER.stacks[i]))
        rows = [(of, -1, 0, 0, cost, audit, illegal)]
        for chunk, back in reversed(steps):
            rows.append((of, chunk, back[at], at, None, None, None))
            at = back[at]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (
            pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["no", "chunk", "start", "end", "cost", "audit", "illegal"])

    of = chunk = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["no"] != of:
                if of is not None:
                    steps.append((chunk, back))
                    state = new
                    yield close()
                of, chunk, last, illegal, steps = row["no"], None, None, 0, []
                new, back = {0: (0, "")}, {}
            if row["chunk"] != chunk:
                if chunk is not None:
                    steps.append((chunk, back))
                state, new, back, chunk = new, {}, {}, row["chunk"]
                illegal += row["inside"] + (last is not None and last + row["first"] not in LEGAL)
                last = row["last"]
            if row["start"] in state:
                cost, audit = state[row["start"]]
                way = (cost + row["cost"], audit + row["audit"])
                if row["end"] not in new or way < new[row["end"]]:
                    new[row["end"]], back[row["end"]] = way, row["start"]
    if of is not None:
        steps.append((chunk, back))
        state = new
        yield close()


def _rebuild(rows: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(ways):
        return pd.DataFrame({"no": [], "chunk": [], "body": []})
    rows = rows.sort_values("pos")
    lines = PARSER.repaired(list(zip(rows["role"], rows["text"], strict=True)), ways["audit"].iloc[0], PARSER.stacks[ways["start"].iloc[0]])
    return pd.DataFrame({"no": [rows["no"].iloc[0]], "chunk": [rows["chunk"].iloc[0]], "body": ["\n".join(lines) if lines else None]})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of, digest, begun = None, sha256(), False
    emit = lambda: pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([digest.hexdigest()])], names=["no", "repaired_sha256"])
    for batch in batches:
        for no, body in zip(batch.column("no").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if no != of:
                if of is not None:
                    yield emit()
                of, digest, begun = no, sha256(), False
            if body is not None:
                digest.update((b"\n" if begun else b"") + body.encode())
                begun = True
    if of is not None:
        yield emit()


def _long(rows: DataFrame, long: DataFrame) -> DataFrame:
    """The results of long conversations, whose rows no task holds together."""
    own = rows.where("NOT gone").join(bounded_broadcast(long), rows["conv"].eqNullSafe(long["of"])).select("no", "turn", "role", "text", F.monotonically_increasing_id().alias("place"))
    order = ["no", *_order(), "place"]
    placed = cut_lineage(own.repartitionByRange(*order).sortWithinPartitions(*order).select("no", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"))
                         .withColumn("chunk", F.shiftright("pos", PIECE_BITS)))
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    compact = placed.select("no", "chunk", "pos", F.left("role", F.lit(1)).alias("initial"), F.sha2(F.concat("role", F.lit("\0"), "text"), 256).alias("digest"),
                            F.when(body == "", "blank").when(F.right(body, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated").alias("fault"))
    firsts = compact.groupBy("no", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    again = (F.col("fault") != "blank") & F.col("is_first").isNull()
    marked = cut_lineage(compact.drop("digest").join(firsts, "pos", "left").select("no", "chunk", "pos", "initial", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault")))
    ways = cut_lineage(marked.groupBy("no", "chunk").applyInPandas(_parse_piece, "no long, chunk long, start int, end int, cost long, audit string, inside long, first string, last string"))
    chained = cut_lineage(ways.repartition("no").sortWithinPartitions("no", "chunk", "start", "end").mapInArrow(
        _chain, "no long, chunk long, start int, end int, cost long, audit string, illegal long"))
    taken = ways.join(chained.select("no", "chunk", "start", "end"), ["no", "chunk", "start", "end"], "left_semi").select("no", "chunk", "start", "audit")
    bodies = placed.groupBy("no", "chunk").cogroup(taken.groupBy("no", "chunk")).applyInPandas(_rebuild, "no long, chunk long, body string")
    digests = bodies.repartition("no").sortWithinPartitions("no", "chunk").mapInArrow(_digest, "no long, repaired_sha256 string")
    counts = marked.groupBy("no").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    turns = placed.groupBy("no").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    return long.join(chained.where("chunk = -1").drop("chunk", "start", "end"), "no").join(counts, "no").join(turns, "no").join(digests, "no").select(F.col("of").alias("conv"), *FIELDS)


def repair_conversations(rows: DataFrame, long: int = LONG) -> DataFrame:
    """The results (conv, ``RESULT``) of rows (conv, turn, role, text, gone)."""
    prepare(rows.sparkSession)
    big = cut_lineage(rows.where("NOT gone").groupBy(F.col("conv").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long)
                      .select("of", F.monotonically_increasing_id().alias("no")))
    some = not big.isEmpty()
    short = rows.join(bounded_broadcast(big), rows["conv"].eqNullSafe(big["of"]), "left_anti") if some else rows
    kind = rows.schema["conv"].dataType.simpleString()
    done = short.repartition("conv").sortWithinPartitions("conv", *_order()).mapInArrow(_whole, f"conv {kind}, {RESULT}")
    return done.unionByName(_long(rows, big)) if some else done


def conversation_repair(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the contract's damaged rows."""
    return repair_conversations(damaged(conversations), long).withColumnRenamed("conv", "conv_id")
