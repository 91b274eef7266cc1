"""Operator 13 [native]: personal data by weak supervision.

Every whole text is searched for the base patterns (email, ip, card, phone) and
for wider forms of personal data. Each match is a candidate span on which six
labelers vote for, against or not at all: the form, a checksum or range, a
gazetteer, words before it that speak for it, words before it that speak
against it, and the characters it touches. Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is for each kind,
and so how likely each pattern is personal data. With these as labels a naive
Bayes span classifier is trained over the votes, the span's shape and length
and the words around it; the spans it accepts are added to the base ones,
which stay.

All of it is DataFrame functions. One scan of the texts writes a row of spans
for each document, without text; the fit and the result read that table. What
reaches the driver is bounded: counts of vote patterns (at most 3^6 a kind) and
of feature buckets. The posteriors are whole millionths, so sums don't depend
on their order. All documents count; nothing is sampled, no text is cut.

A span is ``kind:start:end`` in code points, end exclusive. Null and empty texts
have no spans and still count as documents; null and repeated ids pass through,
a row each; an empty table gives an empty result. Of spans with one start the
kind that is listed first comes first. An added span overlaps no base span, and
no accepted span that sorts before it. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "name")
BASE_KINDS = KINDS[:4]

#: Gazetteers and cue words, all in lower case.
TLDS = "com org net edu gov int mil info biz io dev app eu uk de fr es it nl be ch at pt pl se no dk fi ie us ca au nz jp cn in br mx ar ru".split()
IBAN_COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
GIVEN_NAMES = """alice anna barbara carlos carmen charles claire daniel david elena elizabeth emma francisco hans heinrich helen helga isabel
    jacques james javier jean jennifer john jorge jose joseph juan julia jürgen karen karl katharina klaus laura linda louise lucia luis manuel marco
    margaret maria marie mark martin mary michael michel miguel monika nicolas pablo patricia paul pedro peter pierre richard robert sabine sarah
    sofia sophie stefan susan thomas ursula william wolfgang""".split()
CUES = {
    "email": "e-?mail|mail|contact|write to|reach|correo|courriel|kontakt",
    "ip": r"ip|address|host|server|from|client|login|logged",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|cc",
    "phone": r"phone|tel|telephone|call|mobile|cell|fax|contact|telefon|téléphone|teléfono|whatsapp",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "ssn": r"ssn|social security|social|tax id|taxpayer",
    "name": r"name is|name|mr|mrs|ms|dr|prof|herr|frau|mme|monsieur|madame|sr|sra|señor|señora|dear|signed|patient|contact|author",
}
COUNTER_CUES = {
    "email": "example of|such as|regex|pattern",
    "ip": r"version|v|release|section|chapter|build|rfc|figure",
    "card": r"isbn|order|invoice|tracking|serial|id|ean|upc|issn|doi|no",
    "phone": r"isbn|order|invoice|version|lines|pages|pp|section|serial|id|issn|doi|years",
    "iban": r"serial|part|model|key|token|licen[cs]e",
    "ssn": r"part|serial|model|sku|item|order|invoice|isbn",
    "name": r"the|in|at|of|city|street|university|river|lake|mount|battle|company|band",
}

EMAIL_WORD = "[A-Za-z0-9._%+-]"
#: (kind, whether it is a base pattern, Java pattern, text that must be in it, as a pattern). Quantifiers are possessive and a
#: start inside a run is skipped where that leaves the matches as they are, so that a long run takes neither stack nor square time.
PATTERNS = (
    ("email", True, rf"(?:\G|(?<!{EMAIL_WORD})){EMAIL_WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", True, r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){11}"),
    ("phone", True, r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    ("email", False, rf"(?<!{EMAIL_WORD}){EMAIL_WORD}++(?: ?(?:\(at\)|\[at\]|\{{at\}}) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\{{dot\}}) ?[A-Za-z0-9-]++)++"
                     r"| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)", r"[(\[{]at[)\]}]| dot "),
    ("phone", False, r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![ .-]?[0-9])", r"[0-9]{3}[ .-][0-9]{3}"),
    ("iban", False, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    ("ssn", False, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("name", False, r"(?<!\p{L})\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){1,3}(?!\p{L})", r"\p{Ll} \p{Lu}\p{Ll}"),
)
LABELERS = ("form", "check", "gazetteer", "cue", "counter_cue", "edge")
#: Code points before a span that the context labelers and the word features see.
CONTEXT = 32
#: Feature buckets of a kind: votes of each labeler, shapes, words before, words after, lengths.
SHAPES, WORDS = 512, 1024
OFFSETS = {"votes": 0, "shape": 3 * len(LABELERS), "before": 3 * len(LABELERS) + SHAPES, "after": 3 * len(LABELERS) + SHAPES + WORDS,
           "length": 3 * len(LABELERS) + SHAPES + 2 * WORDS}
SIZE = OFFSETS["length"] + 32
#: An added span's least probability.
ACCEPT = 0.9
MILLION = 1_000_000
#: Values of an array that a running value is computed for at once.
BLOCK = 128
LAST = 2**31 - 1


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when((n - i) % 2 == 1, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0).otherwise(False)


def mod_97(match: Column) -> Column:
    text = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(text, 5, 40), F.left(text, F.lit(4)))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    step = lambda a, i: F.when(code(i) < 58, a * 10 + code(i) - 48).otherwise(a * 100 + code(i) - 55) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def check(kind: str, match: Column) -> Column:
    """The contract's check of a base kind; a like one of the others."""
    count = F.length(digits_of(match))
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: match.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": lambda: luhn(digits_of(match)),
        "phone": lambda: count.between(9, 15),
        "iban": lambda: mod_97(match),
        "ssn": lambda: match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
        "name": lambda: F.lit(True),
    }[kind]()


class _Span(NamedTuple):
    """Columns of one match: itself and what lies before and after, up to the next match of its pattern."""

    match: Column
    before: Column
    after: Column


def _vote(plus: Column, minus: Column) -> Column:
    return F.when(plus, "+").when(minus, "-").otherwise("0")


def votes(kind: str, base: bool, s: _Span, valid: Column) -> Column:
    """One character a labeler: +, - or 0."""
    no, lower = F.lit(False), F.lower(s.match)
    cue = lambda words: s.before.rlike(rf"(?i)(?<!\p{{L}})(?:{words})[^\p{{L}}]{{0,6}}$")
    form: dict[str, Callable[[], Column]] = {
        "email": lambda: _vote(lower.rlike(r"[.](?:[a-z]{2,24})$"), lower.rlike(r"[.][0-9]+$")) if base else F.lit("+"),
        "ip": lambda: _vote(s.match.rlike(r"^(?:[1-9][0-9]*\.){3}[0-9]+$"), s.match.rlike(r"(?:^|\.)0[0-9]")),
        "card": lambda: _vote(s.match.rlike("^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), no),
        "phone": lambda: _vote(s.match.rlike(r"^(?:\+[0-9]{1,3} )?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}$"), s.match.rlike(r"[ ().-]{3}")),
        "iban": lambda: _vote(s.match.rlike("^(?:[A-Z0-9]{4} )+[A-Z0-9]{1,4}$"), no),
        "ssn": lambda: F.lit("+"),
        "name": lambda: F.lit("0"),
    }
    gazetteer: dict[str, Callable[[], Column]] = {
        "email": lambda: _vote(lower.rlike(f"[^a-z](?:{'|'.join(TLDS)})$"), no),
        "ip": lambda: _vote(no, s.match.rlike(r"^(?:0|127|255)\.")),
        "card": lambda: _vote(digits_of(s.match).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|36|38)"), digits_of(s.match).rlike("^[0189]")),
        "phone": lambda: _vote(s.match.rlike(r"^\+(?:1|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])") if base else no, no),
        "iban": lambda: _vote(s.match.rlike(f"^(?:{'|'.join(IBAN_COUNTRIES)})"), F.lit(True)),
        "ssn": lambda: F.lit("0"),
        "name": lambda: _vote(lower.rlike(f"(?:^| )(?:{'|'.join(GIVEN_NAMES)})(?: |$)"), F.lit(True)),
    }
    checked = F.lit("0") if kind in ("email", "name") else _vote(valid, ~valid)
    edge = _vote(F.concat(s.before, s.after).rlike(r"^$") | (s.before.rlike(r"(?:^|[\s,;:(\"'<.])$") & s.after.rlike(r"^(?:$|[\s,;:)\"'>.!?])")),
                 s.before.rlike(r"[\p{L}\p{N}_/=-]$") | s.after.rlike(r"^[\p{L}\p{N}_/=@-]"))
    return F.concat(form[kind](), checked, gazetteer[kind](), _vote(cue(CUES[kind]), no), _vote(no, cue(COUNTER_CUES[kind])), edge)


def _features(kind: str, s: _Span, marks: Column) -> Column:
    """Numbers of the buckets that the span falls in; votes are added when they are known."""
    start = KINDS.index(kind) * SIZE
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(s.match, r"\p{Lu}", "A"), r"\p{Ll}", "a"), "[0-9]", "9")
    shape = F.regexp_replace(shape, r"(.)\1+", "$1")
    bucket = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    word_before = F.lower(F.regexp_extract(s.before, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1))
    word_after = F.lower(F.regexp_extract(s.after, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1))
    by_vote = [F.position(F.substring(marks, i + 1, 1), F.lit("-0+")) - 1 + (start + 3 * i) for i in range(len(LABELERS))]
    return F.array(*by_vote, bucket(shape, SHAPES) + (start + OFFSETS["shape"]), bucket(word_before, WORDS) + (start + OFFSETS["before"]),
                   bucket(word_after, WORDS) + (start + OFFSETS["after"]), F.least(F.length(s.match), F.lit(31)) + (start + OFFSETS["length"]))


SPAN = "array<struct<start int, kind int, end int, base boolean, votes string, features array<int>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each place of an int array, ``op`` over the values before it. An array
    that grows in a fold is copied at each step, so it is done in blocks."""
    grow = lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x)))
    start = F.array(F.lit(zero))

    def joined(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, start, lambda a, block: grow(a, F.element_at(block, -1)))
        return F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), lambda block, before: F.transform(
            F.slice(block, F.lit(1), F.size(block) - 1), lambda x: op(before, x))))

    def in_blocks(v: Column) -> Column:
        firsts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(firsts, lambda i: F.aggregate(F.slice(v, i, F.lit(BLOCK)), start, grow)), joined)

    return let(values, in_blocks)


def candidates(text: Column, kind: str, base: bool, pattern: str, needs: str) -> Column:
    """The matches of one pattern as an array of spans. Their places follow from
    the lengths of the matches and of the pieces between them. A number too
    short or long for a card is no candidate."""

    def placed(x: Column) -> Column:
        before, after = F.slice(x["pieces"], F.lit(1), F.size(x["matches"])), F.slice(x["pieces"], F.lit(2), F.size(x["matches"]))
        at = scan(F.zip_with(x["matches"], before, lambda m, p: F.length(m) + F.length(p)), lambda a, n: a + n, 0)
        return F.arrays_zip(x["matches"].alias("match"), before.alias("piece"), after.alias("next"), at.alias("at"))

    def finish(x: Column) -> Column:
        start = x["at"] + F.length(x["piece"])
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"),
                        F.right(x["piece"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(CONTEXT)).alias("after"), check(kind, x["match"]).alias("valid"))

    def label(x: Column) -> Column:
        s = _Span(x["match"], x["before"], x["after"])
        return F.struct(*[x[c].alias(c) for c in ("start", "kind", "end", "match", "before", "after", "valid")], votes(kind, base, s, x["valid"]).alias("votes"))

    def number(x: Column) -> Column:
        s = _Span(x["match"], x["before"], x["after"])
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), (x["valid"] & F.lit(base)).alias("base"), x["votes"].alias("votes"),
                        _features(kind, s, x["votes"]).alias("features"))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))
    rows = let(both, placed)
    if kind == "card":
        rows = F.filter(rows, lambda x: F.length(digits_of(x["match"])).between(12, 19))
    spans = F.transform(F.transform(F.transform(rows, finish), label), number)
    return F.when(text.rlike(needs), spans).otherwise(F.array()).cast(SPAN)


def pattern_posteriors(counts: dict[tuple[int, str], int], rounds: int = 60) -> dict[tuple[int, str], float]:
    """Probability of personal data for each kind and vote pattern, by
    expectation-maximisation over their counts.

    Each labeler's chances of -, 0 and + are estimated for both classes, with
    pseudo-counts that hold a vote to be right more often than wrong, and the
    share of the classes. It starts from the balance of the votes. A failed
    checksum or range is certain: such patterns stay at 0.
    """
    failed = lambda v: v[LABELERS.index("check")] == "-"
    out: dict[tuple[int, str], float] = {}
    for kind in sorted({k for k, _ in counts}):
        rows = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        post = {v: 0.0 if failed(v) else (1 + v.count("+")) / (2 + v.count("+") + v.count("-")) for v, _ in rows}
        for _ in range(rounds):
            share = (1 + sum(n * post[v] for v, n in rows)) / (2 + sum(n for _, n in rows))
            chance = []
            for i in range(len(LABELERS)):
                table = {"+": [4.0, 1.0], "0": [2.0, 2.0], "-": [1.0, 4.0]}     # [personal, not]: the pseudo-counts
                for v, n in rows:
                    table[v[i]][0] += n * post[v]
                    table[v[i]][1] += n * (1 - post[v])
                sums = [sum(t[c] for t in table.values()) for c in (0, 1)]
                chance.append({m: (t[0] / sums[0], t[1] / sums[1]) for m, t in table.items()})
            for v in (v for v, _ in rows if not failed(v)):
                odds = math.log(share / (1 - share)) + sum(math.log(chance[i][m][0] / chance[i][m][1]) for i, m in enumerate(v))
                post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out.update({(kind, v): post[v] for v, _ in rows})
    return out


def fit(spans: DataFrame) -> list[float]:
    """Weights of the span classifier: the kind's log odds at ``kind * (SIZE + 1)``
    ... of its feature buckets after it (see ``_weights``), from all spans."""
    each = spans.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    counts = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    post = pattern_posteriors(counts)
    if not post:
        return [0.0] * (len(KINDS) * SIZE + len(KINDS))
    labelled = each.sparkSession.createDataFrame([(k, v, round(p * MILLION)) for (k, v), p in sorted(post.items())], "kind int, votes string, p long")
    # At most 3^6 rows a kind.
    weighed = each.join(F.broadcast(labelled), ["kind", "votes"]).select("p", F.explode("features").alias("feature"))
    sums = {r["feature"]: (r["p"], r["n"]) for r in weighed.groupBy("feature").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")).collect()}
    return _weights(counts, post, sums)


def _weights(counts: dict[tuple[int, str], int], post: dict[tuple[int, str], float], sums: dict[int, tuple[int, int]]) -> list[float]:
    weights = [0.0] * (len(KINDS) * SIZE + len(KINDS))
    for kind in range(len(KINDS)):
        yes = sum(n * round(post[k, v] * MILLION) for (k, v), n in sorted(counts.items()) if k == kind) / MILLION
        no = sum(n for (k, _), n in counts.items() if k == kind) - yes
        weights[len(KINDS) * SIZE + kind] = math.log((yes + 1) / (no + 1))
        for at in range(kind * SIZE, (kind + 1) * SIZE):
            if at in sums:
                p, n = sums[at]
                p = p / MILLION
                weights[at] = math.log((p + 0.5) / (yes + 1)) - math.log((n - p + 0.5) / (no + 1))
    return weights


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(id, ``base``, ``added``: arrays of struct<start, kind, end>) for each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.flatten(F.array(*[candidates(text, *p) for p in PATTERNS]))
    spans = cut_lineage(docs.select(F.col(id_col).alias("id"), found.alias("spans")))
    weights = F.split(F.lit(",".join(map(repr, fit(spans)))), ",").cast("array<double>")     # one constant
    score = lambda s: F.aggregate(s["features"], F.element_at(weights, s["kind"] + (len(KINDS) * SIZE + 1)), lambda a, f: a + F.element_at(weights, f + 1))
    likely = lambda s: s["base"] | (score(s) >= math.log(accept / (1 - accept)))
    placed = F.array_sort(F.transform(F.filter("spans", likely), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))

    def apart(all_: Column) -> Column:
        """Spans with the largest end before them and the least start of a base span after them."""
        before = scan(F.transform(all_, lambda s: s["end"]), lambda a, x: F.greatest(a, x), 0)
        after = F.reverse(scan(F.reverse(F.transform(all_, lambda s: F.when(s["base"], s["start"]).otherwise(LAST))), lambda a, x: F.least(a, x), LAST))
        return F.arrays_zip(all_.alias("s"), before.alias("before"), after.alias("after"))

    short = lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["s"]["end"].alias("end"))
    free = lambda x: ~x["s"]["base"] & (x["s"]["start"] >= x["before"]) & (x["s"]["end"] <= x["after"])
    parts = let(let(placed, apart), lambda z: F.struct(F.transform(F.filter(z, lambda x: x["s"]["base"]), short).alias("base"),
                                                       F.transform(F.filter(z, free), short).alias("added")))
    return spans.select(F.col("id").alias(id_col), parts.alias("parts")).select(id_col, "parts.base", "parts.added")


def spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` of base spans, ``base_sha256``, ``spans``) for each document."""
    found = find_pii(docs, id_col, text_col)
    number: Callable[[str], Column] = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(id_col, *[number(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
                        spelled(F.concat("base", "added")).alias("spans"))
