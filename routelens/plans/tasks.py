"""Task evaluations with Spark ML: M01 destination, M02 TTE, M04 driver, M07.

The reference trains a prediction head on its neural encoder; here the trip
features are the k-segment vector of the (truncated) trip plus the start
context, and the models are Spark ML estimators (distributed fitting).
Model choice (M07) fits a small grid on the train split and keeps the best
score on the validation split (A12), then reports test metrics;
``patient_regression`` fits in rounds and stops when the score stays
(``rounds``).
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import hour
from ..operators import metrics
from ..sources.io import write_predictions
from .datasets import EMBED_KSEG, TripDatasets
from .rounds import fit_rounds


def trip_feature_vectors(ds: TripDatasets, pre_length: int = 0) -> DataFrame:
    """split, trip, features: k-seg vector of the trip (cut by pre_length)
    with start hour and weekday scaled to [0, 1]."""
    first = F.col("pts")[0]
    rows = ds.feature_rows.select("split", "trip", (hour(first["seconds"]) / 23.0).alias("h"), (first["weekday"] / 6.0).alias("wd"),
                                  F.slice("pts", F.lit(1), F.greatest(F.col("n") - pre_length, F.lit(0))).alias("pts"))
    kv = ds.kseg_vectors(EMBED_KSEG, rows, ("split", "trip", "h", "wd"))
    # empty segments of very short (cut) trips become 0 for the model
    return (kv.select("split", "trip", array_to_vector(F.concat(
                F.transform("vec", lambda x: F.coalesce(x, F.lit(0.0))), F.array("h", "wd"))).alias("features")))


def _examples(model, data: DataFrame) -> DataFrame:
    """id, label, pred, rank, n_scored of each row, from the model's probabilities on the row."""
    scored = F.transform(vector_to_array("probability"), lambda p, i: F.struct(i.cast("long").alias("cls"), p.alias("score")))
    return metrics.per_row(model.transform(data).select(F.col("trip").alias("id"), F.col("label").cast("long").alias("label"), scored.alias("scores")))


def classification_task(ds: TripDatasets, labels: DataFrame, label_col: str, pre_length: int = 0,
                        reg_params=(0.0, 0.01), eval_split: int = 2, predictions: str | None = None) -> DataFrame:
    """M01/M04 + M07: LogisticRegression per grid point, best on split 1. With
    ``predictions``, label, arg-max and rank of each trip are stored there (S08)."""
    data = trip_feature_vectors(ds, pre_length).join(
        labels.select("trip", F.col(label_col).cast("double").alias("label")), "trip")
    train = data.where("split = 0")
    best = None
    for rp in reg_params:
        model = LogisticRegression(regParam=rp, maxIter=50, family="multinomial").fit(train)
        acc = metrics.metrics_of_examples(_examples(model, data.where("split = 1"))).first()["acc@1"]
        if best is None or acc > best[0]:
            best = (acc, rp, model)
    acc, rp, model = best
    test = _examples(model, data.where(F.col("split") == eval_split))
    if predictions:
        write_predictions(test, predictions)
    return metrics.metrics_of_examples(test).select(
        F.lit(rp).alias("reg_param"), F.lit(acc).alias("val_acc"), "*")


def regression_task(ds: TripDatasets, kind: str = "gbt", eval_split: int = 2, predictions: str | None = None) -> DataFrame:
    """M02 + M07: travel time from trip features; best of a small grid on split 1.
    With ``predictions``, label and prediction of each trip are stored there (S08)."""
    data = trip_feature_vectors(ds).join(ds.tte_labels().select("trip", F.col("tte").alias("label")), "trip")
    train = data.where("split = 0")
    grid = [GBTRegressor(maxDepth=d, maxIter=20, seed=7) for d in (3, 5)] if kind == "gbt" else \
        [LinearRegression(regParam=r) for r in (0.0, 0.1)]
    best = None
    for est in grid:
        model = est.fit(train)
        m = metrics.regression_metrics(model.transform(data.where("split = 1")), "label", "prediction")
        sc = metrics.selection_score(m, "regression").first()["score"]
        if best is None or (sc is not None and sc > best[0]):
            best = (sc, model)
    test = best[1].transform(data.where(F.col("split") == eval_split))
    if predictions:
        write_predictions(test.select("split", "trip", "label", F.col("prediction").alias("pred")), predictions)
    return metrics.regression_metrics(test, "label", "prediction").select(F.lit(best[0]).alias("val_score"), "*")


def patient_regression(ds: TripDatasets, patience: int = 10, max_rounds: int = 40, eval_split: int = 2) -> DataFrame:
    """M02 + M07: travel time by a linear model fitted in rounds, the best round on
    split 1 kept; its test metrics, the round and how many rounds ran."""
    data = trip_feature_vectors(ds).join(ds.tte_labels().select("trip", F.col("tte").alias("label")), "trip")
    data = ds._keep(data.select("split", "trip", "label", vector_to_array("features").alias("features")))
    model, best = fit_rounds(data, 0, patience, max_rounds)
    test = model.predict(data.where(F.col("split") == eval_split), best.state)
    return metrics.regression_metrics(test, "label", "prediction").select(
        F.lit(best.score).alias("val_score"), F.lit(best.round).alias("best_round"), F.lit(best.rounds).alias("rounds"), "*")
