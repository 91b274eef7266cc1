"""Operator 5: language identification with a string kernel.

Two texts are compared by the letter n-grams (1 to 3 letters, word ends
included) that both have, whatever their counts: a blended-spectrum presence
kernel, normalised by the numbers of n-grams present. N-grams are hashed into a
fixed number of places. Landmark texts give a Nyström approximation of the
kernel; ridge regression on it is fitted one language against the rest. Whole
batches of texts are scored by matrix products: presence by landmarks, then by
the fitted weights.

The fit uses a sample of about ``sample`` texts a language (by a hash of the id),
at most ``limit`` in all, and LANDMARKS of them as landmarks: documented bounds,
as the fit needs no more; every document is scored. A text that is null or has
no letter is ``und`` with score 0, as is every text if there is nothing to learn
from. The score is the winning regression value, cut to 0 to 1. Ties go to the
language that sorts first. A null ``doc_id`` isn't held out, nor learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, prepare, slices, texts_of
from .letters import grams, letter_codes

#: Places of the hashed 1-, 2- and 3-grams.
PLACES = (512, 2048, 8192)
LANDMARKS = 128
RIDGE = 1e-2
#: Documents a matrix product takes at once.
BLOCK = 256


def presence(text: str) -> np.ndarray:
    """The sorted places of the n-grams that a whole text has."""
    codes = letter_codes(text)
    if len(codes) < 2:
        return np.zeros(0, np.int64)
    there, base = np.zeros(sum(PLACES), bool), 0
    for n, places in enumerate(PLACES, 1):
        there[base + (grams(codes, n) >> np.uint64(64 - places.bit_length() + 1)).astype(np.int64)] = True
        base += places
    return np.flatnonzero(there)


def _rows(places: list[np.ndarray]) -> np.ndarray:
    """Presence vectors, scaled to length 1."""
    out = np.zeros((len(places), sum(PLACES)), np.float32)
    for i, p in enumerate(places):
        if len(p):
            out[i, p] = 1 / np.sqrt(len(p))
    return out


class Model:
    def __init__(self, places: list[np.ndarray], langs: list[str]):
        """Fit on texts given by their places, and their languages."""
        self.langs = sorted(set(langs))
        x, y = _rows(places), np.array([self.langs.index(k) for k in langs])
        turn = np.argsort([np.flatnonzero(np.flatnonzero(y == y[i]) == i)[0] for i in range(len(y))], kind="stable")    # a text of each language in turn
        self.landmarks = x[turn[:LANDMARKS]]
        values, vectors = np.linalg.eigh((self.landmarks @ self.landmarks.T).astype(np.float64))
        good = values > 1e-6 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        phi = np.hstack([(x @ self.landmarks.T) @ whiten, np.ones((len(x), 1))])
        weight = 1 / np.bincount(y)[y]                          # each language weighs the same
        target = np.eye(len(self.langs))[y]
        gram = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1])
        solution = np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
        self.weights, self.bias = (whiten @ solution[:-1]).astype(np.float32), solution[-1].astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for i in range(0, len(texts), BLOCK):
            places = [presence(t) for t in texts[i:i + BLOCK]]
            values = (_rows(places) @ self.landmarks.T) @ self.weights + self.bias
            best = values.argmax(axis=1)
            top = np.clip(values[np.arange(len(best)), best], 0, 1)
            langs += [self.langs[b] if len(p) else "und" for b, p in zip(best, places, strict=True)]
            scores += [float(s) if len(p) else 0.0 for s, p in zip(top, places, strict=True)]
        return langs, scores


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held_fold: int, sample: int, limit: int) -> Model | None:
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.col(text_col) != "")).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(crc_fold("id", folds) != held_fold)
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(limit).collect()
    if not counts:
        return None
    sample = max(1, min(sample, limit // len(counts)))
    order = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / 2**32
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["n"])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("order"), part.column("lang"), pa.array([presence(t).astype(np.uint16).tobytes() for t in texts_of(part.column("text"))], pa.binary())],
                    names=["order", "lang", "places"])

    drawn = known.select("lang", "text", order.alias("order")).where(F.col("order") < share[F.col("lang")])
    rows = drawn.mapInArrow(run, "order double, lang string, places binary").where("length(places) > 0").limit(2 * limit).collect()
    rows = sorted(map(tuple, rows))
    return Model([np.frombuffer(r[2], np.uint16).astype(np.int64) for r in rows], [r[1] for r in rows]) if rows else None


def language_id(docs: DataFrame, folds: int = 4, held_fold: int = 2, sample: int = 400, limit: int = 8000,
                id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, ``held_out``, ``lang_pred``, ``score``) for each row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, folds, held_fold, sample, limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                langs, scores = shared.value.predict(texts) if shared.value else (["und"] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), (crc_fold("id", folds) == held_fold).alias("held_out"), "lang_pred", "score")
