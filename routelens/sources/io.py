"""Persist and load derived datasets and metrics as Parquet.

Datasets are written partitioned by ``split`` so a later read of one split is
a partition-pruned scan. Paths default to a folder under the cluster's shared
checkpoint directory (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def default_root(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + "/routelens-meta"


def write_meta(df: DataFrame, name: str, root: str | None = None, mode: str = "overwrite") -> str:
    """Write one derived dataset, partitioned by split when present."""
    root = root or default_root(df.sparkSession)
    path = f"{root}/{name}-{uuid.uuid4().hex[:8]}"
    w = df.write.mode(mode)
    if "split" in df.columns:
        w = w.partitionBy("split")
    w.parquet(path)
    return path


def read_meta(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """Read a dataset back; a split filter prunes partitions."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def append_metrics(metrics: DataFrame, task: str, path: str) -> None:
    """Metrics in long form (task, split, metric, value), appended."""
    value_cols = [c for c in metrics.columns if c != "split"]
    stacked = metrics.select(
        F.lit(task).alias("task"),
        (F.col("split") if "split" in metrics.columns else F.lit(None).cast("int")).alias("split"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value"))
                            for c in value_cols])).alias("m"))
    stacked.select("task", "split", "m.metric", "m.value").write.mode("append").parquet(path)


def write_predictions(pred: DataFrame, path: str) -> None:
    """Labels and predictions, when asked to keep them."""
    pred.write.mode("overwrite").parquet(path)
