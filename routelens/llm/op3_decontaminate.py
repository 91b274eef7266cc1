"""Operator 3: benchmark decontamination by SimHash of item-sized windows.

Words are runs of word characters in lower case; a shingle is ``words`` words
(all of them, in an item that is shorter). Windows with as many shingles as an
item slide over each whole document; each gets a SimHash fingerprint weighted
by how often each shingle occurs. Fingerprints within RADIUS bits of the item's
are found by a multi-index: of the 8 bytes of two such fingerprints, at least
one differs in at most RADIUS // 8 bits, and each byte's index lists the items
under all values that near. Candidates are verified by the exact weighted
Jaccard similarity of their shingles. RADIUS is set so that a pair at the
similarity limit passes with over four standard deviations to spare, if no
shingle of either repeats. A shingle that repeats weighs with its square in a
fingerprint, so for an item or a window with one the radius guarantees nothing:
such a window is verified directly if enough of its places hold shingles of the
item for the limit (a bound that every pair at the limit meets).

A window that shares no shingle with any item has similarity 0, so only windows
that reach over a shared shingle are formed; that leaves out none that could
pass. The items are the query set: they are read in blocks of at most about
BLOCK_ITEMS items and BLOCK_BYTES of text, one scan of the documents a block.

Null and empty texts, and items without words, match nothing. A document
shorter than an item is one window. Repeated rows give a match each for every
row; repeated items match each by its own id (repeated rows of an item once).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import filter_rows, prepare, slices, texts_of, union_all

RADIUS = 22
BLOCK_ITEMS = 4096
BLOCK_BYTES = 8 << 20
#: Windows whose fingerprints are computed at once.
WINDOW_BLOCK = 1 << 14

_WORDS = re.compile(r"\w+").findall
_BITS = np.bitwise_count(np.arange(256, dtype=np.uint8))
_NEAR = _BITS[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // 8


def shingles(text: str, words: int) -> list[str]:
    """All runs of ``words`` words, the whole sequence if it is shorter."""
    parts = _WORDS(text.lower())
    if len(parts) <= words:
        return [" ".join(parts)] if parts else []
    return list(map(" ".join, zip(*(parts[i:] for i in range(words)), strict=False)))


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (a.total() + b.total() - both) if both else 0.0


def _sign_bits(names: list[str]) -> np.ndarray:
    """The 64 bits of each shingle's XXH64 as +1 and -1."""
    from xxhash import xxh64_intdigest

    h = np.array([xxh64_intdigest(s) for s in names], ">u8")
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as 8 bytes a row."""
    return np.packbits(sums > 0, axis=1)


class Items:
    """A block of items: shingle index, and for each item size the multi-index of the fingerprints."""

    def __init__(self, rows: list[tuple], words: int):
        self.words = words
        self.ids, self.bags, self.sizes, prints = [], [], [], []
        self.first: dict[int, dict[str, list[int]]] = {}        # by shingle length, as short items have shorter ones
        for item, text in rows:
            names = shingles(text or "", words)
            if not names:
                continue
            k, length = len(self.ids), min(words, names[0].count(" ") + 1)
            self.ids.append(item), self.bags.append(Counter(names)), self.sizes.append((length, len(names)))
            prints.append(_packed(_sign_bits(names).sum(axis=0, keepdims=True))[0])
            for s in set(names):
                self.first.setdefault(length, {}).setdefault(s, []).append(k)
        self.prints = np.array(prints, np.uint8).reshape(-1, 8)
        self.near = {}
        for size in set(self.sizes):
            own = np.array([k for k, s in enumerate(self.sizes) if s == size])
            self.near[size] = own, [_NEAR[:, self.prints[own, b]] for b in range(8)]

    def matches(self, text: str, limit: float) -> list[tuple]:
        """(item, first word, words, similarity, distance): the best window of each item that passes."""
        out = []
        for length, index in self.first.items():
            names = shingles(text, length)
            hits = [(at, index[s]) for at, s in enumerate(names) if s in index]
            if hits and (len(names) > 1 or length == names[0].count(" ") + 1):
                out += self._windows(names, length, hits, limit)
        return out

    def _windows(self, names: list[str], length: int, hits: list, limit: float) -> list[tuple]:
        anchors: dict[int, set[int]] = {}                       # shingles in a window -> places of shared shingles
        for at, items in hits:
            for size in {self.sizes[k][1] for k in items}:
                anchors.setdefault(size, set()).add(at)
        best: dict[int, tuple] = {}
        for size, places in anchors.items():
            last = max(0, len(names) - size)
            at = np.array(sorted(places))
            starts = np.unique(np.clip(at[:, None] - np.arange(size)[None, :], 0, last)) if len(at) * size < 1 << 22 else np.arange(last + 1)
            for i in range(0, len(starts), WINDOW_BLOCK):
                self._block(names, length, size, starts[i:i + WINDOW_BLOCK], limit, best)
            self._uneven(names, length, size, starts, hits, limit, best)
        return [(self.ids[k], start, count + length - 1, sim, dist) for k, (sim, _, start, count, dist) in sorted(best.items())]

    def _block(self, names: list[str], length: int, size: int, starts: np.ndarray, limit: float, best: dict) -> None:
        low, high = int(starts[0]), min(len(names), int(starts[-1]) + size)
        upto = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(_sign_bits(names[low:high]), axis=0, out=upto[1:])
        ends = np.minimum(starts + size, len(names))
        prints = _packed(upto[ends - low] - upto[starts - low])
        own, near = self.near[(length, size)]
        found = near[0][prints[:, 0]]
        for b in range(1, 8):
            found = found | near[b][prints[:, b]]
        w, k = np.nonzero(found)
        distance = _BITS[prints[w] ^ self.prints[own[k]]].sum(axis=1)
        keep = distance <= RADIUS
        for i, item, dist in zip(w[keep].tolist(), own[k[keep]].tolist(), distance[keep].tolist(), strict=True):
            start, end = int(starts[i]), int(ends[i])
            sim = weighted_similarity(self.bags[item], Counter(names[start:end]))
            if sim >= limit and (item not in best or (sim, -start) > best[item][:2]):
                best[item] = (sim, -start, start, end - start, dist)


    def _uneven(self, names: list[str], length: int, size: int, starts: np.ndarray, hits: list, limit: float, best: dict) -> None:
        """Verify the windows in which a shingle repeats, or whose item has one that does, if enough of their shingles are the item's."""
        places: dict[int, list[int]] = {}
        for at, items in hits:
            for k in items:
                if self.sizes[k] == (length, size):
                    places.setdefault(k, []).append(at)
        ends = np.minimum(starts + size, len(names))
        least = limit / (1 + limit) * (size + ends - starts) - 1e-9
        before: np.ndarray | None = None                        # where each shingle was last
        for k, own in places.items():
            shared = np.searchsorted(own, ends) - np.searchsorted(own, starts)
            likely = np.flatnonzero(shared >= least)
            if len(likely) and before is None:
                seen: dict[str, int] = {}
                before = np.array([(seen.get(s, -1), seen.__setitem__(s, i))[0] for i, s in enumerate(names)])
            repeats = max(self.bags[k].values()) > 1
            for start, end in zip(starts[likely].tolist(), ends[likely].tolist(), strict=True):
                if repeats or (before[start:end] >= start).any():
                    sim = weighted_similarity(self.bags[k], Counter(names[start:end]))
                    if sim >= limit and (k not in best or (sim, -start) > best[k][:2]):
                        own_print = _packed(_sign_bits(names[start:end]).sum(axis=0, keepdims=True))[0]
                        best[k] = (sim, -start, start, end - start, int(_BITS[own_print ^ self.prints[k]].sum()))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks by a hash, so that a block is bounded by its share of the table."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // (BLOCK_ITEMS // 2)), -(-int(size) // (BLOCK_BYTES // 2)))
    for b in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()]


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, words: int = 5, limit: float = 0.8,
                      id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, ``start_word``, ``n_words``, ``similarity``, ``distance``): a row for each
    document and item, with the best window (the first of equal ones)."""
    spark = docs.sparkSession
    prepare(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"id {kind}, item {item_kind}, start_word long, n_words long, similarity double, distance int"

    def scan(rows: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, words)
            for batch in batches:
                for part in slices(batch, "text"):
                    at, found = [], []
                    for i, text in enumerate(texts_of(part.column("text"))):
                        got = items.matches(text, limit)
                        at += [i] * len(got)
                        found += got
                    col = lambda j, kind: pa.array([f[j] for f in found], kind)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(at, pa.int64())), pa.array([f[0] for f in found], item_type), col(1, pa.int64()),
                         col(2, pa.int64()), col(3, pa.float64()), col(4, pa.int32())],
                        names=["id", "item", "start_word", "n_words", "similarity", "distance"])

        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''").mapInArrow(run, schema)

    found = union_all([scan(rows) for rows in _blocks(benchmark, item_col, item_text_col)])
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start_word", "n_words", "similarity", "distance")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, limit: float = 0.8, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without a match, with all their columns. Every task drops
    its own rows, block of items after block, so no text is shuffled."""
    prepare(docs.sparkSession)
    for rows in _blocks(benchmark, item_col, item_text_col):
        docs = filter_rows(docs, text_col, _without(docs.sparkSession.sparkContext.broadcast(rows), words, limit))
    return docs


def _without(shared: Broadcast, words: int, limit: float) -> Callable[[pa.Array], list[bool]]:
    items: list[Items] = []                                     # one for each task

    def keep(texts: pa.Array) -> list[bool]:
        if not items:
            items.append(Items(shared.value, words))
        return [not items[0].matches(t, limit) for t in texts_of(texts)]

    return keep
