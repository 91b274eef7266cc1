"""Tables that change by whole folders: staged writes and a manifest.

Under a table's path, ``data/<id>`` folders hold what single writes staged, and
``manifest/<version>.json`` names the folders that make up the table at that
version. A write first stages its folder, which nobody reads yet, and then
commits: it makes the next manifest from the newest one, under a name that
exists only once, so of two writers that start from one version the second
starts over from the first one's result. A write that fails or is killed leaves
a folder that no manifest names. Readers take the newest manifest; the folders
of the version before it stay until the commit after the next, so a reader that
has just begun isn't cut off. All file access goes through the cluster's file
system, so any storage that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Commits that lose to others before a writer gives up.
ATTEMPTS = 20


class NoSnapshot(ValueError):
    """Nothing was committed under this path."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{path}/manifest") if n.endswith(".json") and n[0] != ".")


def _read(spark: SparkSession, path: str, version: int) -> dict:
    fs, at = _fs(spark, f"{path}/manifest/{version:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> dict:
    """The newest manifest; ``NoSnapshot`` if there is none."""
    versions = _versions(spark, path)
    if not versions:
        raise NoSnapshot(f"nothing was written to {path}")
    return _read(spark, path, versions[-1])


def stage(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Write ``df`` to a folder of its own, which no reader sees; its name under ``path``."""
    name = f"data/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(f"{path}/{name}")
    return name


def commit(spark: SparkSession, path: str, change: Callable[[dict], dict]) -> dict:
    """Make ``change`` of the newest manifest (an empty one at first) the next
    version. ``change`` may be called again if another writer was first."""
    for _ in range(ATTEMPTS):
        versions = _versions(spark, path)
        manifest = change(_read(spark, path, versions[-1]) if versions else {})
        version = versions[-1] + 1 if versions else 1
        fs, target = _fs(spark, f"{path}/manifest/{version:012d}.json")
        _, draft = _fs(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not fs.exists(target) and fs.rename(draft, target):
            clean(spark, path)
            return manifest
        fs.delete(draft, False)
    raise RuntimeError(f"{ATTEMPTS} commits to {path} lost to other writers")


def folders_of(manifest: dict) -> set[str]:
    """Every data folder that a manifest names, at any depth."""
    found: set[str] = set()
    todo: list = [manifest]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, list):
            todo += x
        elif isinstance(x, str) and x.startswith("data/"):
            found.add("/".join(x.split("/")[:2]))
    return found


def clean(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the manifests but the newest ``keep``, and folders that only those named.
    A folder that no manifest ever named may be another writer's and stays."""
    versions = _versions(spark, path)
    old = versions[:-keep]
    named = set().union(*(folders_of(_read(spark, path, v)) for v in versions[-keep:])) if versions else set()
    gone = sorted(set().union(*(folders_of(_read(spark, path, v)) for v in old)) - named) if old else []
    for name in [*gone, *(f"manifest/{v:012d}.json" for v in old)]:
        fs, at = _fs(spark, f"{path}/{name}")
        fs.delete(at, True)
    return gone
