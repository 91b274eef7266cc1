"""Models fitted in rounds, with patience.

A round is one step of Adam on the gradient over the whole train split: tasks
add up their rows' gradients, one array a task is summed by place, and an array
of the model's size (features by outputs) reaches the driver. After each round
the model is scored on the validation split (A12); the best round's state is
kept, and the fit ends after ``patience`` rounds without a better score. Data
are read from one written table; a lost executor costs its part of a pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators import metrics


class Fitted(NamedTuple):
    """State of the best round (0 is the start), its score, the rounds that ran and each round's score."""

    state: np.ndarray
    score: float
    round: int
    rounds: int
    history: list[float]


def fit_with_patience(start: np.ndarray, advance: Callable[[np.ndarray, int], np.ndarray], score: Callable[[np.ndarray], float | None],
                      patience: int = 10, max_rounds: int = 40) -> Fitted:
    """Advance from ``start`` until ``patience`` rounds bring no better score (or
    ``max_rounds`` ran). A score that is None or NaN is never better; of equal
    scores the earlier round stays."""
    number = lambda x: -np.inf if x is None or np.isnan(x) else float(x)
    state = best = start
    history = [number(score(start))]
    at, ran = 0, 0
    while ran < max_rounds and ran - at < patience:
        ran += 1
        state = advance(state, ran)
        history.append(number(score(state)))
        if history[-1] > history[at]:
            at, best = ran, state
    return Fitted(best, history[at], at, ran, history)


class LinearRounds(NamedTuple):
    """A linear model of (split, label, features array): ``classes`` 0 for a number, else that many classes by softmax.
    Features (and a number's label) are scaled by the train split's mean and deviation."""

    mean: np.ndarray
    scale: np.ndarray
    centre: float
    spread: float
    classes: int

    def design(self, pdf: pd.DataFrame) -> np.ndarray:
        x = (np.stack([np.asarray(v, np.float64) for v in pdf["features"]]) - self.mean) / self.scale
        return np.concatenate([x, np.ones((len(x), 1))], axis=1)

    def start(self) -> np.ndarray:
        return np.zeros((len(self.mean) + 1, max(1, self.classes)))

    def _outputs(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        out = x @ state
        if self.classes:
            out = np.exp(out - out.max(1, keepdims=True))
            return out / out.sum(1, keepdims=True)
        return out

    def predict(self, rows: DataFrame, state: np.ndarray) -> DataFrame:
        """``rows`` with ``prediction``: the number, or the most likely class (ties to the lowest)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    out = self._outputs(self.design(pdf), state)
                    yield pdf.assign(prediction=out.argmax(1).astype(np.float64) if self.classes else out[:, 0] * self.spread + self.centre)

        return rows.mapInPandas(run, StructType([*(f for f in rows.schema.fields if f.name != "prediction"), StructField("prediction", DoubleType())]))

    def gradient(self, train: DataFrame, state: np.ndarray) -> np.ndarray:
        """Mean gradient of squared error or cross entropy."""
        size = state.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(state.shape), 0
            for pdf in batches:
                if len(pdf):
                    x = self.design(pdf)
                    out, y = self._outputs(x, state), pdf["label"].to_numpy(np.float64)
                    if self.classes:
                        out[np.arange(len(y)), y.astype(int)] -= 1
                    else:
                        out = out - ((y - self.centre) / self.spread)[:, None]
                    total += x.T @ out
                    n += len(y)
            if n:
                yield pd.DataFrame({"at": np.arange(size + 1, dtype=np.int32), "value": np.append(total.ravel(), n)})

        rows = train.select("label", "features").mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        sums = np.zeros(size + 1)
        for r in rows:
            sums[r["at"]] = r["value"]
        return (sums[:size] / max(sums[size], 1)).reshape(state.shape)


def scaled_model(train: DataFrame, classes: int = 0) -> LinearRounds:
    """The model with the scales of ``train``: one aggregate."""
    each = train.select("label", F.posexplode("features").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    label = train.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("s")).first()
    return LinearRounds(np.array([r["m"] for r in each]), np.array([r["s"] or 1.0 for r in each]), label["m"] or 0.0, label["s"] or 1.0, classes)


def fit_rounds(data: DataFrame, classes: int = 0, patience: int = 10, max_rounds: int = 40, rate: float = 0.1) -> tuple[LinearRounds, Fitted]:
    """Fit on split 0, score on split 1 (1 / (mape + 1e-6), or accuracy)."""
    train, val = data.where("split = 0"), data.where("split = 1")
    model = scaled_model(train, classes)
    moments = [np.zeros_like(model.start()), np.zeros_like(model.start())]

    def advance(state: np.ndarray, step: int) -> np.ndarray:
        g = model.gradient(train, state)
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        return state - rate * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.999 ** step)) + 1e-8)

    def score(state: np.ndarray) -> float | None:
        shown = model.predict(val, state)
        if classes:
            return shown.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        return metrics.selection_score(metrics.regression_metrics(shown, "label", "prediction"), "regression").first()["score"]

    return model, fit_with_patience(model.start(), advance, score, patience, max_rounds)
