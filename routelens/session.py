"""Session helpers: configuration, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import BROADCAST_ROW_LIMIT


def _driver_gb() -> int:
    """Local driver heap: 60% of physical memory, at most 16 GB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return max(1, min(16, int(total * 0.6 / 2**30)))
    except (ValueError, OSError, AttributeError):
        return 4


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "routelens") -> SparkSession:
    """Local/test session. On a cluster the caller's session is used as is."""
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", f"{_driver_gb()}g"))
    if master:
        b = b.master(master)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set one only when unset (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="routelens-ckpt-", dir="/tmp")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, eager: bool = True, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: one job (an eager RDD checkpoint computes its input twice),
    lineage cut, and later scans get column pruning and filter pushdown.
    Never a machine-local folder: the folder is ``spark.checkpoint.dir``.
    """
    import uuid
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/routelens-tables/{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)          # no footers to read, and none may be there
    return out if partition_by is None else out.select(*df.columns)       # partition column back in its place


#: Tables that ``cut_lineage`` wrote in this process and that weren't dropped.
_WRITTEN: list[str] = []


def drop_tables(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables that ``cut_lineage`` wrote (all of this process by default);
    frames that read them can't be used afterwards."""
    for path in list(_WRITTEN if paths is None else paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def written_since(mark: int) -> list[str]:
    """Paths of the tables written after there were ``mark`` of them."""
    return _WRITTEN[mark:]


def written_tables() -> int:
    return len(_WRITTEN)


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it
    is, so that Spark shuffles it. The rows of a join are the same either way."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``routelens`` importable in Python workers (pandas UDF closures
    may refer to it) by adding a zip of the package to the session once."""
    import io
    import zipfile
    key = id(spark.sparkContext)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    target = os.path.join(tempfile.mkdtemp(prefix="routelens-pkg-"), "routelens.zip")
    with open(target, "wb") as fh:
        fh.write(buf.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(key)
