"""Operator 4: SimHash near-duplicates by a positional byte index.

A fingerprint is eight bytes. Two that differ in at most 4 bits differ in at
most 4 bytes, so they share at least 4 positional bytes: the guaranteed
minimum of the count filter. The index holds each distinct fingerprint under
byte triples at fixed positions; the positions are chosen so that any 4 of the
8 contain one of the triples, so each pair that can pass the filter meets in
the index. For each pair that meets, the shared positional bytes are tallied,
pairs below the minimum fall out, and the rest are verified by their bits.

No list of the index is paired up with itself: first each fingerprint meets
only the least and the largest of its list; the components of these links are
found; only lists that still hold fingerprints of different components are
compared, and only across components. A group of near copies collapses in the
first pass, so the second sees a few rows of it, whatever its size. Every link
is between fingerprints of one component in the end, so none is lost.

Null and empty texts have fingerprint zero, which links like any other. A null
``doc_id`` never is a component's id unless it has no other. Repeated rows give
repeated results. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, drop_keys, prepare, row_keyed, slices, utf8_of
from .components import components

POSITIONS = 8


def index_triples() -> list[tuple[int, int, int]]:
    """Position triples of which every 4 of the 8 positions contain one: three
    parts, with a triple inside a part, or two of a part and one of the next."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for p in parts for t in combinations(p, 3)]
    for i, p in enumerate(parts):
        out += [tuple(sorted((*two, one))) for two in combinations(p, 2) for one in parts[(i + 1) % 3]]
    return sorted(out)


def simhash(texts: list[bytes], words: int, seed: int = 42) -> np.ndarray:
    """Fingerprints of UTF-8 texts: a bit is set if it is in over half of the
    shingles' XXH64 values, shingles of ``words`` words with repeats."""
    from xxhash import xxh64_intdigest as digest

    hashes: list[int] = []
    begin, count = [], []
    for text in texts:
        parts = text.lower().split()                    # of bytes: A-Z only; splits at 0x20 and 0x09-0x0D
        joined = b" ".join(parts)
        begin.append(len(hashes))
        if len(parts) <= words:
            if parts:
                hashes.append(digest(joined, seed))
        else:
            ends = list(accumulate(len(p) + 1 for p in parts))
            starts = [0, *ends[:len(parts) - words]]
            hashes += [digest(joined[s:e - 1], seed) for s, e in zip(starts, ends[words - 1:], strict=True)]
        count.append(len(hashes) - begin[-1])
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(np.array(count) > 0)
    if len(some):
        every = np.array(hashes, ">u8")
        first, n = np.array(begin)[some], np.array(count)[some]
        sums = np.empty((len(some), 64), np.int64)
        at = 0
        while at < len(some):                           # about a million shingles at a time, or one text
            to = max(at + 1, int(np.searchsorted(first, first[at] + (1 << 20))))
            lo, hi = int(first[at]), int(first[to - 1] + n[to - 1])
            sums[at:to] = _bit_sums(every[lo:hi], first[at:to] - lo)
            at = to
        bits = np.packbits(2 * sums > n[:, None], axis=1)
        out[some] = bits.view(">u8").ravel()
    return out


def _bit_sums(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each bit."""
    total = np.zeros((len(begin), 64), np.int64)
    edges = np.append(begin, len(hashes))
    step = 1 << 17
    for lo in range(0, len(hashes), step):
        hi = min(len(hashes), lo + step)
        own = np.flatnonzero((edges[:-1] < hi) & (edges[1:] > lo))
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1)
        total[own] += np.add.reduceat(bits, np.maximum(edges[own], lo) - lo, axis=0, dtype=np.int32)
    return total


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for each row."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = simhash(utf8_of(part.column("text")), words)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _byte(fp: str | Column, position: int) -> Column:
    return F.shiftrightunsigned(F.col(fp) if isinstance(fp, str) else fp, 8 * position).bitwiseAND(F.lit(255))


def _linked(a: str, b: str, distance: int) -> Column:
    """Tally of shared positional bytes against the guaranteed minimum, then the bits."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    shared = sum((F.when(_byte(differ, i) == 0, 1).otherwise(0) for i in range(POSITIONS)), F.lit(0))
    return (shared >= POSITIONS - distance) & (F.bit_count(differ) <= distance)


def _index(rows: DataFrame) -> DataFrame:
    """A row for each index list that a fingerprint is in: ``key`` holds the list's number and its three bytes."""
    keys = [sum((F.shiftleft(_byte("fp", p), 8 * j) for j, p in enumerate(t)), F.lit(n << 24).cast("long"))
            for n, t in enumerate(index_triples())]
    return rows.select("*", F.explode(F.array(*keys)).alias("key"))


def near_links(distinct: DataFrame, distance: int) -> DataFrame:
    """(``node``, ``root``): the least linked fingerprint of each distinct ``fp`` that has a link."""
    if distance > 4:
        raise ValueError("the index triples hold for at most 4 differing bits")
    index = _index(distinct.select("fp"))
    # What the lists are joined with is written, so that adaptive execution can split a long list.
    ends = cut_lineage(index.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi"))
    near = (index.join(ends, "key").select("fp", F.explode(F.array("lo", "hi")).alias("end"))
            .where((F.col("fp") != F.col("end")) & _linked("fp", "end", distance)))
    first = cut_lineage(components(near.select(F.col("fp").alias("a"), F.col("end").alias("b"))))
    rooted = distinct.select("fp").join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    index = _index(rooted)
    mixed = cut_lineage(index.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"))
    open_ = cut_lineage(index.join(mixed, "key"))
    a = open_.select("key", F.col("fp").alias("fa"), F.col("root").alias("ra"))
    b = open_.select("key", F.col("fp").alias("fb"), F.col("root").alias("rb"))
    across = a.join(b, (a["key"] == b["key"]) & (F.col("ra") < F.col("rb")) & _linked("fa", "fb", distance)).select("ra", "rb").distinct()
    return components(first.select(F.col("node").alias("a"), F.col("root").alias("b"))
                      .unionByName(across.select(F.col("rb").alias("a"), F.col("ra").alias("b"))))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``fingerprint``, ``component_id``) for each row."""
    rows = cut_lineage(fingerprints(docs, words, id_col, text_col))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    links = cut_lineage(near_links(distinct, distance))
    least = cut_lineage(links.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("of_root")))
    linked = links.join(least, "root").select("node", "of_root")
    # Written, so that the last join reads plain exchanges and a fingerprint of many documents is split over tasks.
    ids = cut_lineage(distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("of_root", "least").alias("component_id")))
    return rows.join(ids, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the least id of their component, with all their columns."""
    gone = near_duplicates(docs, words, distance, id_col, text_col).where(f"{id_col} <> component_id").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def keep_one_of_near(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the least id, a
    null one last. Rows go by their own key, so repeated and null ids don't matter."""
    rows = row_keyed(docs)
    own = F.col(f"__doc.{id_col}")
    named = rows.select(F.struct(own.isNull().alias("none"), own.alias("id"), F.col("__row").alias("row")).alias("id"), F.col(f"__doc.{text_col}").alias("text"))
    gone = near_duplicates(named, words, distance, "id", "text").where("id <> component_id").select(F.col("id.row").alias("__gone"))
    return drop_keys(rows, gone)
