"""The trajectory fixture derived from the driver's test tables.

The test data has no GPS points, so trips, trip info, roads and places are
derived deterministically from ``events``, ``supplier`` and ``customer``
(formulas in FIXTURES.md). Everything is a projection of the source tables,
so the fixture grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import nan_to_null

EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
BASE_US = 1704067200000000          # 2024-01-01 00:00:00 in epoch microseconds
PIECE_US = 345600000000             # 4 days
TIME_SQUEEZE_US = 10000000000       # 1000-fold compression, 10-second steps
NUM_ROADS = 97
NUM_DRIVERS = 50


def _us(col: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {col})")


def fixture_trips(events: DataFrame) -> DataFrame:
    us = _us("ts")
    trip = (F.when(F.col("user_id") % 10 == 0,
                   F.lit(1000000) + F.expr("user_id div 30"))
            .otherwise(F.col("user_id") * 10 + F.expr(f"(us - {BASE_US}) div {PIECE_US}")))
    pts = events.select("event_id", "user_id", us.alias("us")).withColumn("trip", trip)
    seconds = (F.lit(1704067200) + F.pmod(F.col("trip"), F.lit(168)) * 3600
               + F.expr(f"(us - {BASE_US}) div {TIME_SQUEEZE_US}") * 10)
    e = F.col("event_id")
    out = pts.select(
        F.col("trip").cast("long").alias("trip"),
        e.alias("seq_i"),
        seconds.cast("long").alias("_seconds"),
        ((e * 7919) % NUM_ROADS).cast("long").alias("road"),
        (((e * 31) % 100).cast("double") / 100).alias("road_prop"),
        F.when(e % 997 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(104.0) + ((e * 7919) % 1000).cast("double") / 50000).alias("lng"),
        (F.lit(30.6) + ((e * 104729) % 1000).cast("double") / 50000).alias("lat"),
    )
    out = out.withColumn("time", F.expr(f"timestampadd(SECOND, _seconds, {EPOCH_NTZ})"))
    return out.select("trip", "time", "road", "road_prop", "lng", "lat", "seq_i")


def fixture_trip_info(trips: DataFrame) -> DataFrame:
    """Distinct trips; the row order of the reference is ascending trip id."""
    return (trips.select("trip").distinct()
            .withColumn("driver", F.pmod(F.col("trip"), F.lit(NUM_DRIVERS)).cast("long")))


def fixture_road_info(trips: DataFrame) -> DataFrame:
    """Roads seen in the trips (0..96), with a deterministic location."""
    return (trips.select("road").distinct()
            .select("road",
                    (F.lit(104.0) + F.col("road").cast("double") / 5000).alias("lng"),
                    (F.lit(30.6) + (F.lit(NUM_ROADS - 1) - F.col("road")).cast("double") / 5000).alias("lat")))


def fixture_pois(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        k.cast("long").alias("poi_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("District "), F.col("s_nationkey").cast("string")).alias("address"),
        (F.lit(104.0) + ((k * 6151) % 1000).cast("double") / 50000).alias("lng"),
        (F.lit(30.6) + ((k * 3571) % 1000).cast("double") / 50000).alias("lat"),
    )


def fixture_pois_large(customer: DataFrame) -> DataFrame:
    """Same formula over customers; keys 1,000 apart share a place (ties)."""
    k = F.col("c_custkey")
    return customer.select(
        k.cast("long").alias("poi_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("District "), F.col("c_nationkey").cast("string")).alias("address"),
        (F.lit(104.0) + ((k * 6151) % 1000).cast("double") / 50000).alias("lng"),
        (F.lit(30.6) + ((k * 3571) % 1000).cast("double") / 50000).alias("lat"),
    )


def fixture_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    trips = nan_to_null(fixture_trips(events))
    return {
        "trips": trips,
        "trip_info": fixture_trip_info(trips),
        "road_info": fixture_road_info(trips),
        "pois": fixture_pois(spark.read.parquet(f"{sf_dir}/supplier.parquet")),
        "pois_large": fixture_pois_large(spark.read.parquet(f"{sf_dir}/customer.parquet")),
    }
