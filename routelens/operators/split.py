"""Splits and filters: F01-F07, R07, R09, U01-U04."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_TRIP_LEN, MIN_TRIP_LEN
from .ordinal import row_ordinal


def split_bounds(n: int, train: float = 0.8, val: float = 0.9) -> tuple[int, int]:
    """Python float truncation, as ``int(n * 0.8)``."""
    return int(n * train), int(n * val)


def assign_split(trip_info: DataFrame, order: str = "trip",
                 train: float = 0.8, val: float = 0.9) -> DataFrame:
    """0/1/2 by row order of trip_info (ascending ``order``).

    The bounds need the trip count: the sum of the ordinal's per-partition
    counts, read back with them.
    """
    ranked, n = row_ordinal(trip_info, [order], name="_ord", with_total=True)
    b1, b2 = split_bounds(n, train, val)
    split = (F.when(F.col("_ord") < b1, F.lit(0))
             .when(F.col("_ord") < b2, F.lit(1)).otherwise(F.lit(2)))
    return ranked.withColumn("split", split.cast("int")).drop("_ord")


def trips_in(points: DataFrame, ids: DataFrame, key: str = "trip") -> DataFrame:
    """Points of the selected trips (left semi join)."""
    return points.join(ids.select(key), key, "left_semi")


def trip_validity(points: DataFrame, cols: list[str] | None = None,
                  min_len: int = MIN_TRIP_LEN, max_len: int = MAX_TRIP_LEN) -> DataFrame:
    """F02 per trip: length, whether any value is missing, and the verdict.

    A plain grouped aggregate, so Spark combines map-side before the shuffle.
    """
    cols = cols or [c for c in points.columns if c != "trip"]
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    agg = points.groupBy("trip").agg(F.count(F.lit(1)).alias("length"),
                                     F.count_if(any_null).alias("null_rows"))
    ok = (F.col("null_rows") == 0) & F.col("length").between(min_len, max_len)
    return agg.withColumn("valid", ok)


def valid_trips(points: DataFrame, split_info: DataFrame | None = None,
                cols: list[str] | None = None) -> DataFrame:
    """ids of valid trips (with their split when ``split_info`` is given)."""
    v = trip_validity(points, cols).where("valid").select("trip", "length")
    if split_info is not None:
        v = v.join(split_info.select("trip", "split"), "trip")
    return v


def known_trips(valid: DataFrame) -> DataFrame:
    """Train and validation trips together."""
    return valid.where(F.col("split").isin(0, 1))


def prefix_sample(ordered: DataFrame, prop: float, n_total: int, ordinal: str = "ordinal") -> DataFrame:
    """the first int(len * prop) rows by ordinal."""
    return ordered.where(F.col(ordinal) < int(n_total * prop))


def truncate_trip(points: DataFrame, pre_length: int) -> DataFrame:
    """drop the last ``pre_length`` points (needs pos and n)."""
    return points.where(F.col("pos") < F.col("n") - pre_length)


def batch_assign(ordered: DataFrame, batch_size: int, ordinal: str = "ordinal") -> DataFrame:
    """Consecutive batches; a trailing batch of one row is dropped."""
    b = ordered.withColumn("batch_id", F.floor(F.col(ordinal) / batch_size).cast("long"))
    sizes = b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_rows"))
    return b.join(sizes.where("batch_rows > 1"), "batch_id").drop("batch_rows")


def seeded_shuffle(df: DataFrame, seed: int, key: list[str], name: str = "shuffled", group: str | None = None) -> DataFrame:
    """A reproducible random order: the rows' ordinal by md5 of the seed
    and their key (unique), restarting per ``group``; no global sort window."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return row_ordinal(df.withColumn("_h", h), ["_h", *key], name=name, group=group).drop("_h")


def query_target_union(qry: DataFrame, tgt: DataFrame) -> DataFrame:
    """Stack queries and targets with a role column."""
    return (qry.withColumn("role", F.lit("qry"))
            .unionByName(tgt.withColumn("role", F.lit("tgt"))))


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct common rows."""
    return a.intersect(b)


def new_vocabulary(vocabulary: DataFrame, words: list[str], n_words: int, n_virtual: int, key: str = "word") -> DataFrame:
    """The first ``n_words`` words and ``n_virtual`` numbered virtual words
    that the vocabulary lacks, each once."""
    asked = list(dict.fromkeys([*words[:n_words], *(f"[anchor{i}]" for i in range(n_virtual))]))
    return set_difference(vocabulary.sparkSession.createDataFrame([(w,) for w in asked], f"{key} string"), vocabulary, key)


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``."""
    return a.join(b.select(key), key, "left_anti")
