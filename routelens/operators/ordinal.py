"""Ordinal of every row in a given order without a global window.

Plan: range-partition on the order keys (Spark samples the bounds), sort within
partitions, tag rows with ``monotonically_increasing_id`` (partition id in the
upper bits, in-partition index in the lower 33 bits), count rows per partition
(one small row per partition), and add the running count of the earlier
partitions. Nothing ever sits in one partition; with a ``group`` key the
ordinal restarts per group and only (partition, group) counts are combined.
Order keys should be unique for a reproducible ordinal.

The tagged frame is written to the shared checkpoint folder before it is used
twice (counts and rows): Spark seeds the range-bound sample with the RDD id,
so two independent evaluations could cut different ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOW = (1 << 33) - 1


def row_ordinal(df: DataFrame, order: list[str], name: str = "ordinal",
                group: str | None = None, num_partitions: int | None = None,
                few_groups: bool = False, with_total: bool = False):
    """0-based ordinal of each row by ``order`` (restarting per ``group``).

    Without a group the per-partition counts (one row per partition) are
    read back and the offsets applied as a literal array: no join. With a
    group the (partition, group) offsets are joined back; ``few_groups``
    broadcasts them (their size is partitions x groups). ``with_total``
    also returns the row count (ungrouped only).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ([group] if group else []) + list(order)
    tagged = cut_lineage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn("_mid", F.monotonically_increasing_id())
                         .withColumn("_pid", F.shiftright("_mid", 33))
                         .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit(_LOW))))
    if not group:
        counts = {r["_pid"]: r["_cnt"] for r in
                  tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt")).collect()}
        offs, run = [], 0
        for pid in range(max(counts) + 1 if counts else 0):
            offs.append(run)
            run += counts.get(pid, 0)
        arr = F.array(*[F.lit(o).cast("long") for o in offs]) if offs else F.array().cast("array<long>")
        out = (tagged.withColumn(name, (F.element_at(arr, (F.col("_pid") + 1).cast("int")) + F.col("_idx")).cast("long"))
               .drop("_mid", "_pid", "_idx"))
        return (out, run) if with_total else out
    gcols = ["_pid", group]
    counts = tagged.groupBy(*gcols).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_idx").alias("_first"))
    # Running count of earlier partitions within the group: a window on the
    # small counts table (one row per partition and group).
    wpart = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(wpart), F.lit(0)))
               .select(*gcols, "_off", "_first"))
    if few_groups:
        offsets = F.broadcast(offsets)
    out = tagged.join(offsets, gcols)
    return (out.withColumn(name, (F.col("_off") + F.col("_idx") - F.col("_first")).cast("long"))
            .drop("_mid", "_pid", "_idx", "_off", "_first"))
