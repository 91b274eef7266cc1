"""Nearest places: J03 and G01 (one exact plan for every size), G02 (text).

Distance is Euclidean on degrees (as the reference's neighbour index), ties
are broken by ``poi_id``. Rows: (``qid``, ``rank`` 0..k-1, ``poi_id``, ``name``,
``address``, ``dist2``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import POI_SEPARATOR
from ..session import cut_lineage

SALT = 16
LEAF = 32            # a cell of at most this many places isn't split further
TASK_QUERIES = 4_096 # queries that go down the tree in one task
MAX_LEVEL = 20       # side of the smallest cells: the box's side / 2**20


def _topk(cands: DataFrame, k: int, salted: bool = False) -> DataFrame:
    """k best (dist2, poi_id) per query. ``salted`` first keeps k per
    (query, hash(poi) % SALT), so a query facing a crowded cell never sorts
    all of that cell's places in one window group."""
    if salted:
        w0 = Window.partitionBy("qid", "_salt").orderBy("dist2", "poi_id")
        cands = (cands.withColumn("_salt", F.pmod(F.xxhash64("poi_id"), F.lit(SALT)))
                 .withColumn("_r0", F.row_number().over(w0)).where(F.col("_r0") <= k)
                 .drop("_salt", "_r0"))
    w = Window.partitionBy("qid").orderBy("dist2", "poi_id")
    return (cands.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))
            .where(F.col("rank") < k))


def dedupe_locations(pois: DataFrame, k: int) -> DataFrame:
    """Places at one identical location tie for every query, and ties go to
    the lower id, so only the k lowest ids of a location can ever be chosen.
    Two-level (salted) so a location holding many copies is never one group."""
    w0 = Window.partitionBy("lng", "lat", "_salt").orderBy("poi_id")
    w1 = Window.partitionBy("lng", "lat").orderBy("poi_id")
    return (pois.withColumn("_salt", F.pmod(F.xxhash64("poi_id"), F.lit(SALT)))
            .withColumn("_r", F.row_number().over(w0)).where(F.col("_r") <= k)
            .withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
            .drop("_salt", "_r"))


def _gap(at: str, low: Column, width: Column) -> Column:
    """Distance along one axis from a point to the interval [low, low + width]."""
    return F.greatest(low - F.col(at), F.col(at) - (low + width), F.lit(0.0))


def _reach(at: str, low: Column, width: Column) -> Column:
    """Largest distance along one axis from a point to the interval."""
    return F.greatest(F.abs(F.col(at) - low), F.abs(F.col(at) - (low + width)))


def knn_poi(queries: DataFrame, pois: DataFrame, k: int) -> DataFrame:
    """The exact k nearest places of each query, by a quadtree of counts.

    The places' box is split into four again and again while a cell holds more
    than LEAF places; only the counts of the cells (``nodes``) are kept. Every
    query starts at the root and goes down level by level: its cells are
    replaced by their occupied children, the k-th smallest "furthest corner"
    (weighted by the counts) bounds the distance of the k-th place, and cells
    that begin beyond the bound are dropped. So a query, wherever it lies and
    however crowded its surroundings, keeps a handful of cells and meets a few
    times LEAF places at the end. The number of levels comes from the counts.

    A query's cells and places stay in the task that the query is in, so the
    queries are dealt to tasks by their number, TASK_QUERIES at most on average:
    more queries make more tasks, not larger ones. Places are ordered by distance
    and id alone, and only those within the bound; the chosen ones get their texts.
    """
    p = dedupe_locations(pois.where(F.col("lng").isNotNull() & F.col("lat").isNotNull()), k)
    b = p.agg(F.count(F.lit(1)).alias("n"), F.min("lng").alias("x0"), F.max("lng").alias("x1"),
              F.min("lat").alias("y0"), F.max("lat").alias("y1")).first()
    if not b["n"] or k <= 0:
        return queries.sparkSession.createDataFrame(
            [], "qid long, rank int, poi_id long, name string, address string, dist2 double")
    x0, y0, cells = b["x0"], b["y0"], 1 << MAX_LEVEL
    side = max(b["x1"] - x0, b["y1"] - y0, 1e-9) * (1 + 1e-9)
    fine = lambda c, low: F.least(F.floor((F.col(c) - low) / side * cells), F.lit(cells - 1)).cast("int")
    placed = p.select(F.monotonically_increasing_id().alias("_p"), "poi_id", "name", "address",     # ids may repeat, rows don't
                      F.col("lng").alias("plng"), F.col("lat").alias("plat"), fine("lng", x0).alias("ix"), fine("lat", y0).alias("iy"))
    levels = lambda df, upto: (df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(upto))))
                               .withColumn("cx", F.expr(f"shiftright(ix, {MAX_LEVEL} - level)"))
                               .withColumn("cy", F.expr(f"shiftright(iy, {MAX_LEVEL} - level)")).drop("ix", "iy"))
    placed = cut_lineage(placed)
    nodes = cut_lineage(levels(placed.select("ix", "iy"), MAX_LEVEL).groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("cnt")))
    crowd = {r["level"]: r["c"] for r in nodes.groupBy("level").agg(F.max("cnt").alias("c")).collect()}
    depth = next((v for v in range(MAX_LEVEL) if crowd[v] <= LEAF), MAX_LEVEL)
    k_eff = min(k, b["n"])

    # A query's cells are few, so they stay together in its window group.
    by_reach = Window.partitionBy("qid").orderBy("_reach").rowsBetween(Window.unboundedPreceding, 0)
    of_query = Window.partitionBy("qid")
    asked = cut_lineage(queries.where(F.col("lng").isNotNull() & F.col("lat").isNotNull()).select("qid", "lng", "lat"))
    n = asked.count()
    few = min(queries.sparkSession.sparkContext.defaultParallelism, -(-n // 512))
    front = (asked.repartition(max(1, few, -(-n // TASK_QUERIES)), "qid")           # a number given is kept
             .select("qid", "lng", "lat", F.lit(0).alias("level"), F.lit(0).alias("cx"), F.lit(0).alias("cy"),
                     F.lit(b["n"]).cast("long").alias("cnt"), F.lit(None).cast("double").alias("_bound")))
    cells_to_ask = nodes.where(F.col("level") <= depth)
    for v in range(1, depth + 1):
        open_ = (F.col("cnt") > LEAF) & (F.col("level") == v - 1)
        cell = lambda x, y, level: F.struct(x.alias("cx"), y.alias("cy"), level.cast("int").alias("level"))
        quarters = F.array(*[cell(F.col("cx") * 2 + i, F.col("cy") * 2 + j, F.lit(v)) for i in (0, 1) for j in (0, 1)])
        # Open cells give way to their quarters, the others stay: one pass, so that a level costs what it holds.
        front = (front.select("qid", "lng", "lat", F.explode(F.when(open_, quarters).otherwise(F.array(cell(F.col("cx"), F.col("cy"), F.col("level"))))).alias("_c"))
                 .select("qid", "lng", "lat", "_c.*").join(cells_to_ask, ["level", "cx", "cy"]))
        width = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
        left, low = F.lit(x0) + F.col("cx") * width, F.lit(y0) + F.col("cy") * width
        front = (front.withColumn("_gap", F.hypot(_gap("lng", left, width), _gap("lat", low, width)))
                 .withColumn("_reach", F.hypot(_reach("lng", left, width), _reach("lat", low, width)))
                 .withColumn("_upto", F.sum("cnt").over(by_reach))
                 .withColumn("_bound", F.min(F.when(F.col("_upto") >= k_eff, F.col("_reach"))).over(of_query))
                 # a little slack, so that rounding never drops a tie
                 .withColumn("_bound", F.col("_bound") * (1 + 1e-9) + 1e-12)
                 .where(F.col("_bound").isNull() | (F.col("_gap") <= F.col("_bound")))
                 .drop("_gap", "_reach", "_upto"))
        if v % 6 == 0:
            front = cut_lineage(front)
    at = levels(placed.select("_p", "poi_id", "plng", "plat", "ix", "iy"), depth)
    cand = front.select("qid", "lng", "lat", "level", "cx", "cy", "_bound").join(at, ["level", "cx", "cy"])
    dx, dy = F.col("plng") - F.col("lng"), F.col("plat") - F.col("lat")
    near = (cand.select("qid", "_p", "poi_id", "_bound", (dx * dx + dy * dy).alias("dist2"))
            .where(F.col("_bound").isNull() | (F.col("dist2") <= F.col("_bound") * F.col("_bound") * (1 + 1e-9))).drop("_bound"))
    top = _topk(near, k_eff, salted=depth == MAX_LEVEL).drop("poi_id")
    return top.join(placed.select("_p", "poi_id", "name", "address"), "_p").select("qid", "rank", "poi_id", "name", "address", "dist2")


def poi_text(neighbours: DataFrame) -> DataFrame:
    """Address of the nearest place + names of all k joined by '、'."""
    s = F.array_sort(F.collect_list(F.struct("rank", "name", "address")))
    return (neighbours.groupBy("qid").agg(s.alias("_s"))
            .select("qid", F.concat(F.col("_s")[0]["address"],
                                    F.array_join(F.transform("_s", lambda r: r["name"]), POI_SEPARATOR))
                    .alias("text")))
