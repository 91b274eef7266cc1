"""Operator 8: quality classifier on random Fourier features.

Every whole text is reduced to statistics (lengths, shares of character kinds,
repetition of words and lines). Standardised over all documents, they are
mapped to random Fourier features, whose inner products approximate a Gaussian
kernel. Each task adds up its part of the normal equations of a ridge fit over
all labelled rows; the sums meet in one matrix of fixed size. Isotonic
regression on the labelled rows, counted in SCORE_BINS bins of the raw score,
turns the raw score into the share of label 1.

Texts that are null or empty have zero statistics and get a score like any
other. Rows without a label (or with a null one) aren't learnt from; repeated
labels of a document count each. With no labelled row every score is 0.5. A
null ``doc_id`` is never labelled or held out. Repeated rows get equal scores;
other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, cut_lineage, filter_rows, prepare, slices, sum_blobs, utf8_of

FEATURES = 256
#: Width of the Gaussian kernel, over standardised statistics.
GAMMA = 0.03
RIDGE = 1e-3
SEED = 8
SCORE_BINS = 2000
#: Standardised statistics are cut to this many deviations, so that one odd text can't tilt the fit.
CLIP = 5.0

_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a"):ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_HIGH = np.arange(256) >= 128
_MARK = ~(_UPPER | _LOWER | _DIGIT | _BLANK | _HIGH)
_STOPS = np.isin(np.arange(256), [ord(c) for c in ".,;:?'\"-"])
N_STATISTICS = 18


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole UTF-8 text."""
    n = len(text)
    if not n:
        return [0.0] * N_STATISTICS
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    count = lambda mask: float(of[mask].sum())
    upper, lower, high, mark = count(_UPPER), count(_LOWER), count(_HIGH), count(_MARK)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    w, m = max(1, len(words)), max(1, len(lines))
    kinds = len(set(words))
    bare = sum(not x.isalpha() and len(x) == 1 for x in words) if mark else 0
    return [
        np.log1p(n), np.log1p(len(words)), (n - count(_BLANK)) / w, kinds / w, np.log(kinds + 1.0) / np.log(w + 1.0),
        sum(map(eq, words, words[1:])) / w, upper / max(1.0, upper + lower), count(_DIGIT) / n, mark / n,
        count(_MARK & ~_STOPS) / w, float(of[_STOPS].sum()) / w, float(of[ord("!")]) / w, float(of[ord("|")]) / w, bare / w,
        high / n, np.log1p(len(lines)), len(words) / m, len(set(lines)) / m]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``x`` array of statistics) for each row."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = pa.array([statistics(t) for t in utf8_of(part.column("text"))], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), x], names=["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, x array<double>")


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Kernel:
    """Standardisation and random Fourier features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, gamma: float = GAMMA, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.weights = rng.normal(0.0, np.sqrt(2 * gamma), (len(mean), features))
        self.shift = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        waves = np.cos(z @ self.weights + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([waves, np.ones((len(x), 1))])


def pool_adjacent(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic fit of positive/total: non-decreasing, least squares, one value for each bin."""
    value, weight, width = [], [], []
    for p, t in zip(positive, total, strict=True):
        value.append(p / t), weight.append(t), width.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            v, n, k = value.pop(), weight.pop(), width.pop()
            value[-1] = (value[-1] * weight[-1] + v * n) / (weight[-1] + n)
            weight[-1] += n
            width[-1] += k
    return np.repeat(value, width)


class Model:
    def __init__(self, kernel: Kernel, solution: np.ndarray):
        self.kernel, self.solution, self.at, self.value = kernel, solution, np.zeros(1), np.full(1, 0.5)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.solution

    def calibrate(self, bins: list[tuple[int, int, int]]) -> None:
        """bins: (bin of the raw score, positive rows, rows)."""
        bins = sorted(bins)
        self.at = np.array([b[0] for b in bins]) / SCORE_BINS
        self.value = pool_adjacent(np.array([b[1] for b in bins], float), np.array([b[2] for b in bins], float))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def bin_of(raw: np.ndarray) -> np.ndarray:
    """A bin of fixed width; raw scores from -1 to 2 have bins of their own, others the outermost."""
    return np.round(np.clip(raw, -1, 2) * SCORE_BINS).astype(np.int64)


def fit(stats: DataFrame, labelled: DataFrame) -> Model:
    """``stats`` (id, x) of all documents; ``labelled`` (x, y double) of the rows to learn from."""
    moments = stats.select(*[F.col("x")[i].alias(f"x{i}") for i in range(N_STATISTICS)]).agg(
        *[F.avg(f"x{i}") for i in range(N_STATISTICS)], *[F.stddev_pop(f"x{i}") for i in range(N_STATISTICS)]).first()
    mean = np.array([m or 0.0 for m in moments[:N_STATISTICS]])
    scale = np.array([s if s and s > 1e-9 else 1.0 for s in moments[N_STATISTICS:]])
    kernel, size = Kernel(mean, scale), FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size * size + size + 1)
        for batch in batches:
            if batch.num_rows:
                z, y = kernel(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False)
                total += np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])
        if total[-1]:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "blob": pa.array([total.tobytes()], pa.binary())})

    blob = sum_blobs(labelled.select("x", "y").mapInArrow(equations, "part int, blob binary"))
    if blob is None:
        return Model(kernel, np.zeros(size))
    total = np.frombuffer(blob)
    gram, right, n = total[:size * size].reshape(size, size), total[size * size:-1], total[-1]
    model = Model(kernel, np.linalg.solve(gram / n + RIDGE / size * np.eye(size), right / n))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(bin_of(model.raw(_matrix(batch)))), batch.column("y")], names=["bin", "y"])

    counts = labelled.select("x", "y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.sum("y"), F.count(F.lit(1)))
    model.calibrate([tuple(r) for r in counts.collect()])           # at most 3 * SCORE_BINS + 1 rows
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, threshold: float = 0.3,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) for each row."""
    stats, model = learn(docs, labels, folds, held_fold, id_col, text_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], names=["id", "score"])

    return stats.select("id", "x").mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(id_col), (crc_fold("id", folds) == held_fold).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def learn(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, Model]:
    """The written statistics of all documents and the model of the labelled ones."""
    stats = cut_lineage(document_statistics(docs, id_col, text_col))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(crc_fold("id", folds) != held_fold)
    return stats, fit(stats, cut_lineage(stats.join(known, "id").select("x", "y")))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_fold: int = 0,
                     id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents predicted as 1, with all their columns. The model is small,
    so every task scores the rows that it holds and no text is shuffled."""
    _, model = learn(docs, labels, folds, held_fold, id_col, text_col, label_col)

    def keep(texts: pa.Array) -> list[bool]:
        return (model.score(np.array([statistics(t) for t in utf8_of(texts)])) >= threshold).tolist()

    return filter_rows(docs, text_col, keep)
