"""Datasets by their type string: build, write, read back.

    trip | odpois[-k[-pre[-momentum]]] | destination | tte | driver
    hopqrytgt[-n] | hopqrytgtpois[-n[-k]] | hopnegindex[-n[-m]]

A written dataset is Parquet under ``root/<type>[_grid]``, a folder for each
split; a manifest names the folders that hold now (``sources.snapshots``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import sketches, stats
from ..sources import snapshots
from .datasets import NUMERIC_POINT_COLS, TripDatasets

MOTION_COLS = ("speed", "acceleration", "heading_angle")
_DEFAULTS = {"trip": (), "destination": (), "tte": (), "driver": (), "odpois": (5, 0, 0),
             "hopqrytgt": (1000,), "hopqrytgtpois": (1000, 5), "hopnegindex": (1000, 10000)}


def parse_type(name: str) -> tuple[str, tuple[int, ...]]:
    """Kind and parameters, missing ones at their defaults; an unknown kind,
    a parameter too many or one that isn't a number is an error."""
    kind, *given = name.split("-")
    if kind not in _DEFAULTS:
        raise ValueError(f"no dataset type {kind!r}; one of {', '.join(_DEFAULTS)}")
    defaults = _DEFAULTS[kind]
    if len(given) > len(defaults):
        raise ValueError(f"{kind} takes at most {len(defaults)} parameters")
    return kind, (*map(int, given), *defaults[len(given):])


def build(ds: TripDatasets, name: str, splits: tuple[int, ...] = (0, 1, 2), seed: int = 0) -> DataFrame:
    """The dataset of a type string for the chosen splits; searches run for these alone."""
    kind, p = parse_type(name)
    made = {
        "trip": lambda: ds.trip_features, "destination": ds.destination_labels, "tte": ds.tte_labels, "driver": ds.driver_labels,
        "odpois": lambda: ds.od_pois(p[0], p[1], bool(p[2]), splits=splits), "hopqrytgt": lambda: ds.hop_query_target(p[0]),
        "hopqrytgtpois": lambda: ds.hop_query_target_pois(p[0], p[1], splits), "hopnegindex": lambda: ds.negatives(p[0], p[1], seed, splits=splits),
    }[kind]()
    return made.where(F.col("split").isin(*splits))


def _path(root: str, name: str, grid: bool) -> str:
    return f"{root.rstrip('/')}/{name}" + "_grid" * grid


def dump(ds: TripDatasets, name: str, root: str, splits: tuple[int, ...] = (0, 1, 2), seed: int = 0) -> str:
    """Write the dataset of some splits. They replace what was written of
    these splits before, in one commit; the other splits stay as they are. If it
    fails, all stay. A split without rows is written as empty."""
    path = _path(root, name, ds.dims is not None)
    made = build(ds, name, splits, seed)
    schema = made.schema
    folder = snapshots.stage(made, path, partition_by="split")

    def change(manifest: dict) -> dict:
        known = manifest.get("columns")
        if known and StructType.fromJson(known).simpleString() != schema.simpleString():
            raise ValueError(f"{path} has other columns; write to another root")
        return {"columns": schema.jsonValue(), "splits": {**manifest.get("splits", {}), **{str(s): f"{folder}/split={s}" for s in splits}}}

    snapshots.commit(ds.spark, path, change)
    return path


def load(spark: SparkSession, root: str, name: str, split: int | None = None, grid: bool = False) -> DataFrame:
    """The written splits of a dataset, or one of them: only its files are
    read. A split that was never written is an error, not an empty table."""
    path = _path(root, name, grid)
    manifest = snapshots.latest(spark, path)
    schema, folders = StructType.fromJson(manifest["columns"]), manifest["splits"]
    if split is not None and str(split) not in folders:
        raise snapshots.NoSnapshot(f"split {split} of {path} was not written")
    stored = StructType([f for f in schema.fields if f.name != "split"])
    kind = schema["split"].dataType

    def one(number: str) -> DataFrame:
        try:
            rows = spark.read.schema(stored).parquet(f"{path}/{folders[number]}")
        except AnalysisException as e:                           # no row of this split, so no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = spark.createDataFrame([], stored)
        return rows.withColumn("split", F.lit(int(number)).cast(kind)).select(*schema.names)

    return reduce(DataFrame.unionByName, [one(n) for n in sorted(folders) if split is None or n == str(split)])


class StaleStatistics(ValueError):
    """The stored statistics are of other data."""


def _inputs(ds: TripDatasets) -> dict[str, dict[str, str]]:
    """Content fingerprints of the tables that statistics depend on."""
    return {"trips": sketches.fingerprint(ds.trips), "trip_info": sketches.fingerprint(ds.trip_info), "road_info": sketches.fingerprint(ds.road_info)}


def _sketched(ds: TripDatasets) -> DataFrame:
    return sketches.sketch(ds.motion_all, NUMERIC_POINT_COLS)


def write_stats(ds: TripDatasets, root: str, expanded: bool = True) -> str:
    """``stat`` (of the points as loaded, motion features 0), ``info``
    (cardinalities) and, if asked for, ``expanded_stat`` (after K01), with a
    sketch that later trips can be merged into. One commit replaces all that was
    stored, together with the fingerprint of the tables it is of."""
    path = _path(root, "stats", ds.dims is not None)
    raw = ds.points.select(*[F.col(c) if c in ds.points.columns else F.lit(0.0).alias(c) for c in NUMERIC_POINT_COLS])
    parts = {"stat": stats.describe(ds._keep(raw), NUMERIC_POINT_COLS), "info": ds.cardinalities()}
    if expanded:
        parts |= {"expanded_stat": ds.describe_all(), "sketch": _sketched(ds), "trip_ids": ds.validity.select("trip")}
    manifest = {"inputs": _inputs(ds), "tables": {k: [snapshots.stage(v, path)] for k, v in parts.items()}, "heading": ds.heading}
    snapshots.commit(ds.spark, path, lambda _: manifest)
    return path


def merge_stats(more: TripDatasets, root: str) -> str:
    """Add trips that the stored statistics don't have yet (``more`` has these
    trips only); nothing stored is computed again. The statistics become those of
    all trips: counts, means, deviations and bounds as if computed anew, quartiles
    within ``sketches.ACCURACY``. A trip that is stored already is an error, since
    its new points change the motion features of the old ones."""
    spark, path = more.spark, _path(root, "stats", more.dims is not None)
    old = snapshots.latest(spark, path)
    if "sketch" not in old["tables"]:
        raise StaleStatistics(f"{path} has no sketch; write the expanded statistics first")
    if old["heading"] != more.heading or more.dims is not None:
        raise StaleStatistics("a sketch is of one heading rule and of the road network")
    read = lambda k: spark.read.parquet(*[f"{path}/{f}" for f in old["tables"][k]])
    if not more.validity.join(read("trip_ids"), "trip", "left_semi").isEmpty():
        raise ValueError("some of these trips are in the stored statistics")
    tables = {"sketch": [*old["tables"]["sketch"], snapshots.stage(_sketched(more), path)],
              "trip_ids": [*old["tables"]["trip_ids"], snapshots.stage(more.validity.select("trip"), path)]}
    whole = spark.read.parquet(*[f"{path}/{f}" for f in tables["sketch"]])
    described = sketches.describe(whole)
    raw = described.withColumns({c: F.when(F.col("column").isin(*MOTION_COLS), 0.0).otherwise(F.col(c)) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})
    counts = more.cardinalities().crossJoin(F.broadcast(read("info").toDF("had_road", "had_class")))        # one row each
    info = counts.select(F.greatest("num_road", "had_road").alias("num_road"), F.greatest("num_class", "had_class").alias("num_class"))
    tables |= {"expanded_stat": [snapshots.stage(described.drop("distinct"), path)], "stat": [snapshots.stage(raw.drop("distinct"), path)],
               "info": [snapshots.stage(info, path)]}
    new = _inputs(more)
    if new["road_info"] != old["inputs"]["road_info"]:
        raise StaleStatistics("the road table has changed")
    inputs = {**{k: sketches.add_fingerprints(old["inputs"][k], new[k]) for k in ("trips", "trip_info")}, "road_info": old["inputs"]["road_info"]}

    def change(manifest: dict) -> dict:
        if manifest != old:
            raise StaleStatistics(f"{path} was written meanwhile")
        return {**old, "inputs": inputs, "tables": tables}

    snapshots.commit(spark, path, change)
    return path


def load_stats(spark: SparkSession, root: str, grid: bool = False, of: TripDatasets | None = None) -> tuple[DataFrame, DataFrame]:
    """(statistics, cardinalities); the expanded statistics if the last write
    had them. With ``of``, its tables are compared with those that the statistics
    were made from (one scan), and ``StaleStatistics`` raised if they differ."""
    path = _path(root, "stats", grid if of is None else of.dims is not None)
    manifest = snapshots.latest(spark, path)
    if of is not None and (_inputs(of) != manifest["inputs"] or of.heading != manifest["heading"]):
        raise StaleStatistics(f"the statistics at {path} are of other data")
    tables = manifest["tables"]
    read = lambda k: spark.read.parquet(*[f"{path}/{f}" for f in tables[k]])
    return read("expanded_stat" if "expanded_stat" in tables else "stat"), read("info")
