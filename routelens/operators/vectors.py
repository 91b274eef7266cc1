"""Vectors: X01 (caller's batch encoder), M06 (several vectors joined), J09.

The trigonometric encodings (P19-P21) live in ``functions.encodings``; the
embedding lookup (J07) is a join in the registry; approximate neighbours (G09)
are in ``operators.ivf``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import l2_distance
from ..session import cut_lineage
from .ordinal import row_ordinal


#: In a Python worker: the encoders that were set up there, by call of ``encode_trips``.
_READY: dict[str, Callable] = {}


def length_batches(lengths: np.ndarray, step: int, size: int) -> list[np.ndarray]:
    """Positions in batches of at most ``size`` rows whose lengths round up to
    one multiple of ``step``: padding adds less than ``step`` points a row."""
    of = -(-lengths // step)
    order = np.lexsort((lengths, of))
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [part[i:i + size] for part in np.split(order, cuts) for i in range(0, len(part), size)]


def encode_trips(rows: DataFrame, cols: list[str], setup: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
                 dim: int, keys: tuple[str, ...] = ("trip",), step: int = 8, size: int = 256) -> DataFrame:
    """A caller's batch encoder over whole trips (``rows`` with arrays ``pts``): ``keys`` and ``vec``.

    ``setup`` is called once in a Python worker (it loads the model) and returns
    the encoder, which gets a (B, L, len(cols)) array, padded with each trip's
    last point (R05), and the B lengths, and returns (B, dim). Trips of similar
    length make a batch, so padding stays under ``step`` points a trip. NULL
    features are NaN; a trip without points gets a NULL vector. No shuffle: a
    trip is a row already, of a length that the validity filter bounds.
    """
    width, name = len(cols), uuid.uuid4().hex
    flat = F.flatten(F.transform("pts", lambda p: F.array(*[F.coalesce(p[c].cast("double"), F.lit(float("nan"))) for c in cols])))
    seq = rows.select(*keys, flat.alias("_flat"))

    def run(batches):
        for table in batches:
            flats = [np.asarray(x, dtype=np.float64) for x in table.column("_flat").to_pandas().map(lambda x: [] if x is None else x)]
            lengths = np.array([len(x) // width for x in flats], dtype=np.int64)
            out: list = [None] * len(flats)
            for part in length_batches(lengths, step, size) if len(flats) else []:
                part = part[lengths[part] > 0]
                if not len(part):
                    continue
                if name not in _READY:
                    _READY[name] = setup()
                longest = lengths[part].max()
                pad = np.stack([(a := flats[i].reshape(-1, width))[np.minimum(np.arange(longest), len(a) - 1)] for i in part])
                for i, v in zip(part, np.asarray(_READY[name](pad, lengths[part]), dtype=np.float64).reshape(len(part), dim), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([*[table.column(k) for k in keys], pa.array(out, pa.list_(pa.float64()))], names=[*keys, "vec"])

    return seq.mapInArrow(run, T.StructType([*[seq.schema[k] for k in keys], T.StructField("vec", T.ArrayType(T.DoubleType()))]))


def joined_vectors(frames: list[DataFrame], keys: tuple[str, ...] = ("split", "trip")) -> DataFrame:
    """Several vectors of each trip joined into one, in the given order."""
    out = frames[0].select(*keys, F.col("vec").alias("_v0"))
    for i, f in enumerate(frames[1:], 1):
        out = out.join(f.select(*keys, F.col("vec").alias(f"_v{i}")), list(keys))
    return out.select(*keys, F.concat(*[f"_v{i}" for i in range(len(frames))]).alias("vec"))


def summary_encoder(pts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A small example encoder: each column's mean, standard deviation, first and last value."""
    real = (np.arange(pts.shape[1]) < lengths[:, None])[..., None]
    mean = np.where(real, pts, 0.0).sum(1) / lengths[:, None]
    spread = np.sqrt((np.where(real, pts - mean[:, None], 0.0) ** 2).sum(1) / lengths[:, None])
    return np.concatenate([mean, spread, pts[:, 0], pts[np.arange(len(pts)), lengths - 1]], 1)


def anchor_blocks(anchors: DataFrame, block: int) -> DataFrame:
    """(_block, _anchors): the anchors (``anchor``, ``avec``) in arrays of at most ``block``, by ``anchor``."""
    listed = F.array_sort(F.collect_list(F.struct("anchor", "avec")))
    placed = row_ordinal(anchors.select("anchor", "avec"), ["anchor"], "_at")
    return cut_lineage(placed.groupBy(F.floor(F.col("_at") / block).alias("_block")).agg(listed.alias("_anchors")))


def anchor_scores(rows: DataFrame, anchors: DataFrame, vec: str = "vec", block: int = 512) -> DataFrame:
    """``rows`` with ``scores``: an array (cls: the anchor, score: minus its
    distance), by blocks of at most ``block`` anchors, which are sent as one row
    each. No row of a pair is formed and ``rows`` isn't shuffled. A NULL vector
    has NULL scores; without anchors the array is empty."""
    out = rows.withColumn("scores", F.array().cast("array<struct<cls:bigint,score:double>>"))
    blocks = anchor_blocks(anchors, block)
    for r in blocks.select("_block").orderBy("_block").collect():           # one row for each block of anchors
        one = blocks.where(F.col("_block") == r["_block"]).select("_anchors")
        each = F.transform("_anchors", lambda a: F.struct(a["anchor"].cast("long").alias("cls"), (-l2_distance(vec, a["avec"])).alias("score")))
        out = out.crossJoin(F.broadcast(one)).withColumn("scores", F.concat("scores", each)).drop("_anchors")
    return out


def anchor_attention(rows: DataFrame, anchors: DataFrame, vec: str = "vec", block: int = 512) -> DataFrame:
    """``rows`` with ``attended``: the anchors' vectors (``avec``) weighted by
    softmax(vec . avec / sqrt(d)).

    One pass, on the row itself: blocks of at most ``block`` anchors are sent as
    one row each, and a row carries the largest score so far, the sum of
    exponentials below it and the weighted vector, rescaled when a larger score
    comes. No row of a pair is formed and ``rows`` isn't shuffled. Anchors go by
    ``anchor``; without anchors, or for a NULL vector, ``attended`` is NULL.
    """
    blocks = anchor_blocks(anchors, block)
    state = "struct<top:double,total:double,sum:array<double>>"
    out = rows.withColumn("_state", F.lit(None).cast(state))

    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731    a value that is computed once

    def take(s: Column, a: Column) -> Column:
        score = F.aggregate(F.zip_with(vec, a["avec"], lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x) / F.sqrt(F.size(vec).cast("double"))

        def weigh(x: Column) -> Column:
            top = F.greatest(s["top"], x)                       # greatest() skips the NULL of the start
            return F.struct(top.alias("top"), F.coalesce(F.exp(s["top"] - top), F.lit(0.0)).alias("old"), F.exp(x - top).alias("new"))

        def add(w: Column) -> Column:
            had = F.coalesce(s["sum"], F.transform(a["avec"], lambda x: F.lit(0.0)))
            return F.struct(w["top"].alias("top"), (F.coalesce(s["total"], F.lit(0.0)) * w["old"] + w["new"]).alias("total"),
                            F.zip_with(had, a["avec"], lambda t, x: t * w["old"] + x * w["new"]).alias("sum"))

        return once(score, lambda x: F.when(x.isNull(), s).otherwise(once(weigh(x), add)))

    for r in blocks.select("_block").orderBy("_block").collect():           # one row for each block of anchors
        one = blocks.where(F.col("_block") == r["_block"]).select("_anchors")
        out = out.crossJoin(F.broadcast(one)).withColumn("_state", F.aggregate("_anchors", F.col("_state"), take)).drop("_anchors")
    return out.withColumn("attended", F.transform(F.col("_state")["sum"], lambda x: x / F.col("_state")["total"])).drop("_state")
