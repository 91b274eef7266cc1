"""Statistics that can be merged: of parts of a table, into those of the whole.

For each numeric column: count, sum and sum of squared deviations (merged
pairwise, stable for large values), bounds, a quantile sketch (counts of
logarithmic bins, so a quantile is off by at most ``ACCURACY`` of its value) and
a distinct sketch (maxima of 2^REGISTERS hash registers). Bins and registers of
two parts merge by sum and maximum to just what one pass over both gives.

A content fingerprint, the number of rows and the sum of their hashes, adds up
likewise, whatever the order of rows and files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 0.005
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
REGISTERS = 11
#: ``at`` of the rows that hold moments and bounds; bins and registers have their own number there.
SCHEMA = "column string, kind string, at int, n long, total double, m2 double, low double, high double"


def _bin(x: Column) -> Column:
    """Number of a value's bin: 0 for zero, else the logarithm above any double's, with the value's sign."""
    size = F.ceil(F.ln(F.abs(x)) / F.lit(math.log(GAMMA))).cast("int") + 100_000
    return F.when(x == 0, 0).when(x > 0, size).otherwise(-size)


def bin_value(number: int) -> float:
    """The value that stands for a bin."""
    if number == 0:
        return 0.0
    return math.copysign(2 * GAMMA ** (abs(number) - 100_000) / (GAMMA + 1), number)


def sketch(df: DataFrame, cols: list[str]) -> DataFrame:
    """The sketch of ``df``: rows of ``SCHEMA``, a few thousand a column at most. NULL, NaN and infinite values don't count."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.select(F.explode(pairs).alias("p")).select("p.column", "p.x").where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    none = F.lit(None).cast("double")
    moments = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), (F.var_pop("x") * F.count(F.lit(1))).alias("m2"),
                                         F.min("x").alias("low"), F.max("x").alias("high"))
    # One pass for bins and registers: each value counts in one bin and one register.
    hashed = F.xxhash64(F.col("x") + 0.0)
    rest = F.shiftrightunsigned(hashed, REGISTERS)
    zeros = F.lit(65 - REGISTERS) - F.length(F.regexp_replace(F.bin(rest), "^0+", ""))
    cells = long.select("column", F.explode(F.array(
        F.struct(F.lit("bin").alias("kind"), _bin(F.col("x")).alias("at"), F.lit(None).cast("int").alias("zeros")),
        F.struct(F.lit("register").alias("kind"), F.pmod(hashed, F.lit(1 << REGISTERS)).cast("int").alias("at"), zeros.alias("zeros")))).alias("c"))
    counted = cells.groupBy("column", "c.kind", "c.at").agg(F.count(F.lit(1)).alias("n"), F.max("c.zeros").alias("zeros"))
    return (moments.select("column", F.lit("moments").alias("kind"), F.lit(0).alias("at"), "n", "total", "m2", "low", "high")
            .unionByName(counted.select("column", "kind", "at", F.when(F.col("kind") == "bin", F.col("n")).otherwise(F.col("zeros")).cast("long").alias("n"),
                                        none.alias("total"), none.alias("m2"), none.alias("low"), none.alias("high"))))


def merge(parts: DataFrame) -> DataFrame:
    """The sketch of all rows behind a union of sketches."""
    total = F.sum("n")
    moments = parts.where("kind = 'moments'")
    means = moments.groupBy("column").agg((F.sum("total") / total).alias("mean"))
    around = F.col("total") / F.col("n") - F.col("mean")
    moments = moments.join(means, "column").groupBy("column").agg(
        F.lit("moments").alias("kind"), F.lit(0).alias("at"), total.alias("n"), F.sum("total").alias("total"),
        F.sum(F.col("m2") + F.col("n") * around * around).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"))
    none = F.lit(None).cast("double")
    cells = parts.where("kind <> 'moments'").groupBy("column", "kind", "at").agg(
        F.when(F.col("kind") == "bin", total).otherwise(F.max("n")).alias("n"))
    return moments.unionByName(cells.select("column", "kind", "at", "n", none.alias("total"), none.alias("m2"), none.alias("low"), none.alias("high")))


def describe(parts: DataFrame) -> DataFrame:
    """One row a column, as ``stats.describe`` gives, quartiles within ``ACCURACY``
    of their value (nearest rank below), and the estimated ``distinct`` values."""
    rows = merge(parts).collect()                                # a few thousand a column
    out = []
    for m in sorted((r for r in rows if r["kind"] == "moments"), key=lambda r: r["column"]):
        bins = sorted((r["at"], r["n"]) for r in rows if r["column"] == m["column"] and r["kind"] == "bin")
        registers = [r["n"] for r in rows if r["column"] == m["column"] and r["kind"] == "register"]
        quartiles = []
        for q in (0.25, 0.5, 0.75):
            rank, below = math.floor((m["n"] - 1) * q), 0
            for at, n in bins:
                below += n
                if below > rank:
                    break
            quartiles.append(min(max(bin_value(at), m["low"]), m["high"]))
        std = math.sqrt(m["m2"] / (m["n"] - 1)) if m["n"] > 1 else None
        out.append((m["column"], m["n"], m["total"] / m["n"], std, m["low"], *quartiles, m["high"], distinct_of(registers)))
    return parts.sparkSession.createDataFrame(
        out, "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double, distinct long")


def distinct_of(registers: list[int]) -> int:
    """Estimate from the registers that have a value."""
    m = 1 << REGISTERS
    empty = m - len(registers)
    estimate = 0.7213 / (1 + 1.079 / m) * m * m / (empty + sum(2.0 ** -r for r in registers))
    return round(m * math.log(m / empty) if estimate <= 2.5 * m and empty else estimate)


def fingerprint(df: DataFrame) -> dict[str, str]:
    """Number of rows and sum of row hashes, of all columns by name, as text; the order of rows doesn't matter."""
    row = F.xxhash64(*[F.struct(F.lit(c), F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in sorted(df.columns)])
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return {"rows": str(got["n"]), "hash": str(int(got["h"]))}


def add_fingerprints(a: dict[str, str], b: dict[str, str]) -> dict[str, str]:
    """The fingerprint of the rows of both."""
    return {k: str(int(a[k]) + int(b[k])) for k in a}
