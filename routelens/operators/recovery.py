"""The recovery objective, every discrete and continuous feature of the
next point and the words of the places at a trip's ends.

Discrete features are predicted by sparse counts with back-off, continuous ones
by a ridge regression from summed normal equations. Counts have one row for each
combination that occurs; the regression leaves one row of sums.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def backoff_cross_entropy(rows: DataFrame, target: str, contexts: list[tuple[str, ...]], train: Column, test: Column,
                          n_classes: int | None = None, strength: float = 1.0) -> DataFrame:
    """One row (``loss``, ``n``): the mean of -ln p(target | contexts) over the ``test`` rows.

    ``contexts`` go from the most to the least specific. The prior is add-one
    over ``n_classes`` (by default the targets that occur, and one more); each
    context's counts among the ``train`` rows are mixed with ``strength`` counts
    of the next less specific estimate. A context with a NULL, or unseen, takes
    that estimate. Rows without a target don't count; without test rows ``loss``
    is NULL. The rows are read and shuffled once, as counts.
    """
    every = list(dict.fromkeys(c for ctx in contexts for c in ctx))
    counts = cut_lineage(rows.where(F.col(target).isNotNull()).groupBy(*every, F.col(target).alias("_y"))
                         .agg(F.count_if(train).alias("_c"), F.count_if(test).alias("_n")))
    prior = counts.groupBy("_y").agg(F.sum("_c").alias("_c0"))
    sizes = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_t0"), (F.count_distinct("_y") + 1).alias("_classes"))     # one row
    seen = counts.where("_n > 0").drop("_c").join(prior, "_y").crossJoin(F.broadcast(sizes))
    p = (F.col("_c0") + 1) / (F.col("_t0") + (F.col("_classes") if n_classes is None else F.lit(n_classes)))
    for i, ctx in reversed(list(enumerate(contexts, 1))):
        pair = counts.groupBy(*ctx, "_y").agg(F.sum("_c").alias(f"_c{i}"))
        total = counts.groupBy(*ctx).agg(F.sum("_c").alias(f"_t{i}"))
        seen = seen.join(pair, [*ctx, "_y"], "left").join(total, list(ctx), "left")
        p = (F.coalesce(f"_c{i}", F.lit(0)) + F.lit(strength) * p) / (F.coalesce(f"_t{i}", F.lit(0)) + F.lit(strength))
    return seen.agg((F.sum(-F.log(p) * F.col("_n")) / F.sum("_n")).alias("loss"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def _complete(rows: DataFrame, cols: list[str]) -> DataFrame:
    return rows.where(reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(c), cols, F.lit(True)))


def ridge_fit(rows: DataFrame, features: list[str], targets: list[str], ridge: float = 1.0) -> np.ndarray:
    """Coefficients (1 + features, targets) by the normal equations, which one
    aggregate sums up; the intercept isn't penalised. Rows with a NULL or NaN
    don't count; without rows all coefficients are 0."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    y = [F.col(c).cast("double") for c in targets]
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(x[i] * t).alias(f"b{i}_{j}") for i in range(k) for j, t in enumerate(y)]
    got = _complete(rows, [*features, *targets]).agg(*sums).first()
    if not got["a0_0"]:
        return np.zeros((k, len(y)))
    a = np.array([[got[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([[got[f"b{i}_{j}"] for j in range(len(y))] for i in range(k)])
    return np.linalg.solve(a + ridge * np.diag([0.0] + [1.0] * (k - 1)), b)


def ridge_errors(rows: DataFrame, features: list[str], targets: list[str], coefficients: np.ndarray) -> DataFrame:
    """Rows (``feature``: a target, ``loss``, ``n``): the mean squared error of each target."""
    def error(j: int, t: str) -> Column:
        terms = [F.lit(float(coefficients[i + 1, j])) * F.col(c) for i, c in enumerate(features)]
        off = reduce(lambda a, b: a + b, terms, F.lit(float(coefficients[0, j]))) - F.col(t)
        return F.avg(off * off).alias(f"_{j}")

    one = _complete(rows, [*features, *targets]).agg(*[error(j, t) for j, t in enumerate(targets)], F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(t).alias("feature"), F.col(f"_{j}").alias("loss")) for j, t in enumerate(targets)])
    return one.select(F.explode(each).alias("_e"), "n").select("_e.feature", "_e.loss", "n")


def objective(parts: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """The parts (kind, weight, rows of ``feature``, ``loss``, ``n``) as one table,
    and a row ``total``: the sum of weight x loss (NULL if a loss is missing)."""
    table = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "feature", F.lit(float(w)).alias("weight"), "loss", F.col("n").cast("long").alias("n"))
                                           for kind, w, df in parts])
    table = cut_lineage(table)                  # a few rows, read twice
    whole = F.when(F.count("loss") == F.count(F.lit(1)), F.sum(F.col("weight") * F.col("loss")))
    total = table.agg(whole.alias("loss"), F.max("n").alias("n")).select(
        F.lit("total").alias("kind"), F.lit("").alias("feature"), F.lit(1.0).alias("weight"), "loss", "n")
    return table.unionByName(total)
