"""Load the four trajectory tables from Parquet with checked schemas.

NaN in floating columns becomes NULL at load so that every later statistic and
guard deals with one kind of missing value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPS_SCHEMA = T.StructType([
    T.StructField("trip", T.LongType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("road", T.LongType()),
    T.StructField("road_prop", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("seq_i", T.LongType()),
])
TRIP_INFO_SCHEMA = T.StructType([
    T.StructField("trip", T.LongType()),
    T.StructField("driver", T.LongType()),
])
ROAD_INFO_SCHEMA = T.StructType([
    T.StructField("road", T.LongType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])
POIS_SCHEMA = T.StructType([
    T.StructField("poi_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (Spark keeps them apart)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def conform(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """Check that the required columns exist and cast them to the declared types."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return nan_to_null(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                                   for f in schema.fields]))


def load_trips(spark: SparkSession, path: str, road_info: DataFrame | None = None) -> DataFrame:
    """S01 trips. Without lng/lat columns they are attached from ``road_info``."""
    df = spark.read.parquet(path)
    if ("lng" not in df.columns or "lat" not in df.columns) and road_info is not None:
        from ..operators.stats import attach_road_coords
        df = (attach_road_coords(df.drop("lng", "lat"), road_info)
              .withColumnsRenamed({"road_lng": "lng", "road_lat": "lat"}))
    return conform(df, TRIPS_SCHEMA, "trips")


def load_trip_info(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), TRIP_INFO_SCHEMA, "trip_info")


def load_road_info(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), ROAD_INFO_SCHEMA, "road_info")


def load_pois(spark: SparkSession, path: str) -> DataFrame:
    """Only name, address, lng, lat are used. Without a ``poi_id`` the places
    are numbered in the order of their values, whatever the file layout."""
    df = spark.read.parquet(path)
    if "poi_id" not in df.columns:
        from ..operators.ordinal import row_ordinal
        df = row_ordinal(df, ["lng", "lat", "name", "address"], name="poi_id")
    return conform(df, POIS_SCHEMA, "pois")
