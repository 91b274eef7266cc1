"""Operator 9: toxicity with a counterfactual-regularised classifier.

A whole text is the set of its words, their beginnings of 5 to 7 letters and the
letter 5-grams in them (word ends included), hashed into PLACES places. From labelled rows, each place's
counts by label choose the FEATURES places that tell most. A logistic
regression on them is fitted with one more penalty: in each labelled sentence
that mentions an identity group, the terms are swapped for those of other
groups, and the squared change of the score is added to the loss. So a neutral
mention of a group can't carry weight, whatever the labels say.

The fit uses a sample of at most about ``sample`` labelled rows for each label
(by a hash of the id; both labels weigh the same in the loss) and PAIRS swapped sentences:
documented bounds. The counts are added up over tasks; what reaches the driver
is one array of counts and each sampled row's chosen places. All rows are
scored. Null and empty texts have no places and score what the bias says; with no
labelled row, or of one label only, every score is that label's share (0 with
none). A null ``doc_id`` is never labelled or held out; null labels aren't
learnt from; repeated rows get equal scores; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, cut_lineage, prepare, slices, sum_blobs, texts_of
from .letters import grams, grams_at, hashed_words, letter_codes

PLACES = 1 << 18
FEATURES = 1024
#: A place must occur in this many labelled rows to be a feature.
LEAST_ROWS = 4
SWAP_WEIGHT = 10.0
RIDGE = 1e-3
STEPS = 300
PAIRS = 20_000

#: Terms for groups of people, interchangeable within a line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "nonbinary", "transgender"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("africans", "europeans", "americans", "mexicans", "indians", "arabs"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "athées"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "atheisten"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "ateos"),
)
_NEXT = {t: line[(i + 1) % len(line)] for line in IDENTITY_TERMS for i, t in enumerate(line)}
_TERMS = re.compile(r"\b(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b", re.IGNORECASE)
_SENTENCES = re.compile(r"[^.!?\n]+").findall


def all_places(text: str) -> np.ndarray:
    """The place of each word, beginning and 5-gram of a whole text, with repeats."""
    codes = letter_codes(text)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    inside = codes == 0
    h = grams(codes, 5)
    if len(h):
        h = h[~(inside[1:-3] | inside[2:-2] | inside[3:-1])]    # a word end may only come first or last
    every = [h, hashed_words(codes)]
    at = np.flatnonzero(inside[:-1])
    for n in (6, 7, 8):
        at = at[at + n < len(codes)]
        at = at[~inside[at + n - 1]]                            # words of at least n - 1 letters
        if len(at):
            every.append(grams_at(codes, n, at))
    return (np.concatenate(every) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)


def places(text: str) -> np.ndarray:
    """The sorted places of a whole text."""
    return np.unique(all_places(text))


def swapped(sentence: str) -> str | None:
    """The sentence with each identity term swapped for the next of its line; None if it has none."""
    out, n = _TERMS.subn(lambda m: _NEXT[m.group().lower()], sentence)
    return out if n else None


class Model:
    """Chosen places and their weights."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.bias = bias
        self.weights = np.zeros(PLACES)
        self.weights[chosen] = weights

    def score(self, text: str) -> float:
        at = all_places(text)
        at = np.unique(at[self.weights[at] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.weights[at].sum() + self.bias, -500, 500))))


def choose(counts: np.ndarray) -> np.ndarray:
    """The places that tell most: by the log-likelihood ratio of occurrence and label.
    ``counts``: rows of label 0 and 1 with each place, then rows of label 0 and 1."""
    with_, rows = counts[:-2].reshape(2, -1).astype(np.float64), counts[-2:].astype(np.float64)
    total = with_.sum(axis=0)
    table = [(with_[y], rows[y] * total / rows.sum()) for y in (0, 1)] + [(rows[y] - with_[y], rows[y] * (rows.sum() - total) / rows.sum()) for y in (0, 1)]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(np.where(seen > 0, seen * np.log(seen / expected), 0) for seen, expected in table)
    gain[total < LEAST_ROWS] = 0
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    return np.sort(best[gain[best] > 0])


def solve(rows: list[tuple[float, float, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, float]:
    """Weights and bias for rows (label, weight, places) and pairs of places before and after a swap."""
    y, weight = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    weight = weight / weight.sum()
    row = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    col = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int64)
    p_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    p_col = np.concatenate([np.concatenate(p) for p in pairs]) if pairs else np.zeros(0, np.int64)
    sign = np.concatenate([np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in pairs]) if pairs else np.zeros(0)
    w, b = np.zeros(size), float(np.log(max(1e-6, weight @ y) / max(1e-6, 1 - weight @ y)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):                            # Adam on the whole sample
        z = np.bincount(row, w[col], len(rows)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad = np.append(np.bincount(col, error[row], size) + RIDGE * w / max(1, len(rows)) ** 0.5, error.sum())
        if len(pairs):
            change = np.bincount(p_row, sign * w[p_col], len(pairs))
            grad[:-1] += 2 * SWAP_WEIGHT / len(pairs) * np.bincount(p_col, sign * change[p_row], size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_fold: int, sample: int) -> Model:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where((crc_fold("id", folds) != held_fold) & F.col("y").isin(0, 1))
    n = dict(map(tuple, known.groupBy("y").count().collect()))
    if len(n) < 2:
        share = float(next(iter(n), 0))
        return Model(np.zeros(0, np.int64), np.zeros(0), 40.0 * (2 * share - 1))
    rate = {y: min(1.0, sample / n[y]) for y in n}
    order = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / 2**32
    drawn = known.where(order < F.when(F.col("y") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0])))
    # At most about 2 * sample ids, so they may be sent to every task.
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("id", "text", "y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((2, PLACES), np.int32)
        seen = np.zeros(2, np.int32)
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), texts_of(batch.column("text")), strict=True):
                total[y, places(text)] += 1
                seen[y] += 1
        if seen.any():
            blob = np.concatenate([total.ravel(), seen]).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    blob = sum_blobs(rows.select("y", "text").mapInArrow(count, "part int, blob binary"), "int32")
    if blob is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    chosen = choose(np.frombuffer(blob, np.int32))
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.full(PLACES, -1, np.int32)
        at[shared.value] = np.arange(len(shared.value))
        own = lambda text: np.unique((x := at[all_places(text)])[x >= 0]).tobytes()
        for batch in batches:
            ids, ys, before, after = [], [], [], []
            for i, y, text in zip(batch.column("id").to_pylist(), batch.column("y").to_pylist(), texts_of(batch.column("text")), strict=True):
                ids.append(str(i)), ys.append(y), before.append(own(text)), after.append(None)
                for sentence in _SENTENCES(text) if _TERMS.search(text) else ():
                    if (other := swapped(sentence)) is not None:
                        ids.append(str(i)), ys.append(None), before.append(own(sentence)), after.append(own(other))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ys, pa.int32()), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                                             names=["id", "y", "before", "after"])

    small = cut_lineage(rows.mapInArrow(reduce_, "id string, y int, before binary, after binary"))
    got = sorted(map(tuple, small.where("y IS NOT NULL").select("id", "y", "before").collect()))
    some = small.where("y IS NULL AND before <> after").select(F.md5(F.concat("id", F.hex("before"))).alias("o"), "before", "after").orderBy("o", "before", "after").limit(PAIRS).collect()
    ints = lambda b: np.frombuffer(b, np.int32).astype(np.int64)
    weight = {y: 1 / n[y] / rate[y] for y in n}                 # both labels weigh the same, whatever their shares
    w, b = solve([(float(y), weight[y], ints(x)) for _, y, x in got], [(ints(r["before"]), ints(r["after"])) for r in some], len(chosen))
    return Model(chosen, w, b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, threshold: float = 0.5, sample: int = 8000,
                    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) for each row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, folds, held_fold, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = [shared.value.score(t) for t in texts_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), (crc_fold("id", folds) == held_fold).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
