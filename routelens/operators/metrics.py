"""Metrics as grouped aggregates: A08-A12, A14-A16, G04, G07.

Scores come in long form (id, cls, score), one row per example and class, where
every metric is a grouped aggregate or an equi-join on the example id; or, where
one model scores all classes, as an array (cls, score) on the example's row,
where rank, arg-max and entropy are expressions and nothing is shuffled before
the aggregates over examples. Nothing is sorted globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                       keys: tuple[str, ...] = ()) -> DataFrame:
    """Rmse, mae, mape; mape skips zero labels and reports how many."""
    err = F.col(pred) - F.col(label)
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(F.abs(F.try_divide(err, F.when(F.col(label) != 0, F.col(label))))).alias("mape"),
        F.count_if(F.col(label) == 0).alias("mape_skipped"))


def selection_score(metrics: DataFrame, kind: str) -> DataFrame:
    """Model-selection score; regression 1/(mape+1e-6), classification acc."""
    if kind == "regression":
        return metrics.withColumn("score", F.lit(1.0) / (F.col("mape") + F.lit(1e-6)))
    return metrics.withColumn("score", F.col("acc@1"))


def argmax_class(scores: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Class with the highest score; ties go to the lowest class, NULL scores don't count."""
    return scores.groupBy(*keys).agg(
        F.max_by("cls", F.when(F.col("score").isNotNull(), F.struct(F.col("score"), -F.col("cls")))).alias("pred"))


def score_rank(scores: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rank 1.. of each class score per example, descending; ties put the
    higher class first (the reversed ascending sort of the reference).

    The window is per example, so its size is the number of classes.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("cls").desc())
    return scores.withColumn("rank", F.row_number().over(w))


def truth_rank(scores: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """A11 per example: 1 + #(score > truth) + #(score == truth and cls > truth);
    NULL for a labelled example whose truth has no score."""
    return per_example(scores, labels, keys).select(*keys, "rank")


def per_example(scores: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, label, pred (arg-max, ties to the lowest class), rank of the truth
    (G04 tie rule; NULL if the truth has no score) and the number of scored
    classes, for every labelled example, from one shuffle: the join by example
    id; the window and the aggregate reuse its partitioning."""
    j = labels.join(scores, list(keys), "left")
    w = Window.partitionBy(*keys)
    j = j.withColumn("_ts", F.max(F.when(F.col("cls") == F.col("label"), F.col("score"))).over(w))
    ahead = (F.col("score") > F.col("_ts")) | ((F.col("score") == F.col("_ts")) & (F.col("cls") > F.col("label")))
    return j.groupBy(*keys, "label").agg(
        F.max_by("cls", F.when(F.col("score").isNotNull(), F.struct(F.col("score"), -F.col("cls")))).alias("pred"),
        F.when(F.max("_ts").isNull(), F.lit(None))
         .otherwise(F.lit(1) + F.count_if(ahead)).cast("long").alias("rank"),
        F.count("score").alias("n_scored"))


def _of_truth(scores: str, label: str) -> Column:
    """The score of the label in an array (cls, score) without NULL scores; NULL if it has none."""
    return F.array_max(F.transform(F.filter(scores, lambda s: s["cls"] == F.col(label)), lambda s: s["score"]))


def per_row(rows: DataFrame, keys: tuple[str, ...] = ("id",), scores: str = "scores", label: str = "label") -> DataFrame:
    """``per_example`` of rows that hold their classes' ``scores`` as an array of
    (cls, score): expressions on the row, no shuffle. NULL scores don't count; a
    row without scores has no prediction and no rank."""
    ready = rows.select(*keys, F.col(label).alias("label"), F.filter(F.coalesce(F.col(scores), F.array().cast(rows.schema[scores].dataType)),
                                                                     lambda s: s["score"].isNotNull()).alias("_s"))
    best = F.array_max(F.transform("_s", lambda s: F.struct(s["score"].alias("score"), (-s["cls"]).alias("less"))))

    def place(truth: Column) -> Column:
        ahead = F.filter("_s", lambda s: (s["score"] > truth) | ((s["score"] == truth) & (s["cls"] > F.col("label"))))
        return F.when(truth.isNotNull(), F.lit(1).cast("long") + F.size(ahead))

    rank = F.element_at(F.transform(F.array(_of_truth("_s", "label")), place), 1)         # the truth's score is computed once
    return ready.select(*keys, "label", (-best["less"]).alias("pred"), rank.alias("rank"), F.size("_s").cast("long").alias("n_scored"))


def entropy_of_rows(rows: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """``cross_entropy`` of rows that hold their classes' scores as an array: one aggregate."""
    ready = rows.select(F.col(label).alias("label"), F.filter(scores, lambda s: s["score"].isNotNull()).alias("_s"))

    def log_sum(top: Column) -> Column:
        return top + F.log(F.aggregate("_s", F.lit(0.0), lambda t, s: t + F.exp(s["score"] - top)))

    lse = F.element_at(F.transform(F.array(F.array_max(F.transform("_s", lambda s: s["score"]))), log_sum), 1)
    return (ready.select(_of_truth("_s", "label").alias("_truth"), lse.alias("_lse"))
            .agg(F.avg(F.col("_lse") - F.col("_truth")).alias("cross_entropy"), F.count_if(F.col("_truth").isNull()).alias("unscored")))


def classification_metrics(scores: DataFrame, labels: DataFrame,
                           keys: tuple[str, ...] = ("id",), ns: tuple[int, ...] = (5, 10),
                           group: tuple[str, ...] = ()) -> DataFrame:
    """mean_rank, macro_f1, macro_rec, acc@1, acc@n, unscored.

    All averages run over every labelled example. One whose truth has no score
    is a miss: it ranks behind as many classes as any example has, and is
    counted in ``unscored``.
    Macro averages run over the classes seen in truth or prediction; a class
    with no true or no predicted example scores 0 (zero_division=0).
    ``group`` columns (e.g. split) must be part of ``keys``.
    """
    return metrics_of_examples(per_example(scores, labels, keys), ns, group)


def metrics_of_examples(per: DataFrame, ns: tuple[int, ...] = (5, 10), group: tuple[str, ...] = ()) -> DataFrame:
    """A09-A11 of the examples (``per_example``, ``per_row``); the table, one row
    an example, is written for the three small aggregates."""
    ns = tuple(n for n in ns if n != 1)       # acc@1 comes from the arg-max
    per = cut_lineage(per)
    hit = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("double"))
    unscored = F.count_if(F.col("rank").isNull())
    aggs = [((F.coalesce(F.sum("rank"), F.lit(0)) + unscored * (F.max("n_scored") + 1)) / F.count(F.lit(1))).alias("mean_rank"),
            hit(F.col("pred") == F.col("label")).alias("acc@1"), unscored.alias("unscored")]
    aggs += [hit(F.col("rank") <= n).alias(f"acc@{n}") for n in ns]
    head = per.groupBy(*group).agg(*aggs)
    # Per-class counts: true, predicted, hits. Two small grouped aggregates.
    t = per.groupBy(*group, F.col("label").alias("c")).agg(
        F.count(F.lit(1)).alias("n_true"),
        F.count_if(F.col("pred") == F.col("label")).alias("tp"))
    p = per.where(F.col("pred").isNotNull()).groupBy(*group, F.col("pred").alias("c")).agg(F.count(F.lit(1)).alias("n_pred"))
    pc = t.join(p, [*group, "c"], "full_outer").fillna(0, ["n_true", "tp", "n_pred"])
    f1 = F.when(F.col("n_true") + F.col("n_pred") > 0,
                2 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(F.lit(0.0))
    macro = pc.groupBy(*group).agg(F.avg(f1).alias("macro_f1"), F.avg(rec).alias("macro_rec"))
    out = head.crossJoin(macro) if not group else head.join(macro, list(group))
    return out.select(*group, "mean_rank", "macro_f1", "macro_rec", "acc@1", *[f"acc@{n}" for n in ns], "unscored")


def cross_entropy(scores: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Mean over examples of logsumexp(scores) - score[truth], and how many
    labelled examples have no score of their truth (``unscored``; they have no
    entropy). One shuffle of the scores: the window by example and the aggregate
    use the join's partitioning."""
    top = F.max("score").over(Window.partitionBy(*keys))
    per = labels.join(scores, list(keys), "left").withColumn("_top", top).groupBy(*keys, "label").agg(
        (F.first("_top") + F.log(F.sum(F.exp(F.col("score") - F.col("_top"))))).alias("_lse"),
        F.max(F.when(F.col("cls") == F.col("label"), F.col("score"))).alias("_truth"))
    return per.agg(F.avg(F.col("_lse") - F.col("_truth")).alias("cross_entropy"), F.count_if(F.col("_truth").isNull()).alias("unscored"))


def multi_mse(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean squared error over several (pred, label) column pairs together."""
    sq = None
    for p, l in pairs:
        e = (F.col(p) - F.col(l)) * (F.col(p) - F.col(l))
        sq = e if sq is None else sq + e
    return df.agg((F.sum(sq) / (F.count(F.lit(1)) * len(pairs))).alias("mse"))
