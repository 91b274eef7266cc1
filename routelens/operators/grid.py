"""Grid road type: P15, P16 and the cardinalities that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import GRID_STEP_DEGREE
from ..functions import geo


def grid_dims(trips: DataFrame, step: float = GRID_STEP_DEGREE) -> DataFrame:
    """One row: the box of all points (x0, x1, y0, y1) and the cells along it."""
    box = trips.agg(F.min("lng").alias("x0"), F.max("lng").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    return box.select("*", F.ceil((F.col("x1") - F.col("x0")) / step).cast("long").alias("num_w"),
                      F.ceil((F.col("y1") - F.col("y0")) / step).cast("long").alias("num_h"))


def project_to_grid(trips: DataFrame, dims: DataFrame) -> DataFrame:
    """``road`` replaced by the cell of the point; NULL without a place."""
    p = trips.crossJoin(F.broadcast(dims))                              # one row
    cell = geo.grid_index("lat", "y0", "y1", "num_h") * F.col("num_w") + geo.grid_index("lng", "x0", "x1", "num_w")
    return p.withColumn("road", cell.cast("long")).select(*trips.columns)


def grid_cells(dims: DataFrame, step: float = GRID_STEP_DEGREE) -> DataFrame:
    """Road, lng, lat of every cell's centre, dealt over the cluster by ``range``."""
    size = dims.select("num_w", "num_h").first()
    cells = dims.sparkSession.range((size["num_w"] or 0) * (size["num_h"] or 0)).withColumnRenamed("id", "road")
    return cells.crossJoin(F.broadcast(dims)).select(
        F.col("road").cast("long").alias("road"),
        (F.pmod(F.col("road"), F.col("num_w")) * step + step / 2 + F.col("x0")).alias("lng"),
        (F.floor(F.col("road") / F.col("num_w")) * step + step / 2 + F.col("y0")).alias("lat"))


def cardinalities_grid(road_info: DataFrame, trip_info: DataFrame, dims: DataFrame) -> DataFrame:
    """A02 for the grid type: num_road, num_class, num_w, num_h."""
    from .stats import cardinalities
    return cardinalities(road_info, trip_info).crossJoin(dims.select("num_w", "num_h"))
