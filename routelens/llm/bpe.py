"""Byte-pair merging in numpy: a hashed pair table and padded matrices.

Each row of a matrix is one pre-token, padded to the width of its length
bucket. In each round every row merges its leftmost pair of least rank; rows
without a known pair leave the matrix (compaction). Pre-tokens longer than the
widest bucket go through the same merges with a heap, in n log n steps.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Width limits of the length buckets, in bytes; a matrix has about CELLS cells.
WIDTHS = (2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256)
CELLS = 1 << 18
NO_RANK = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table (left id, right id) -> (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(len(keys) * 2 + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << bits, NO_RANK, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        at, todo = self._home(keys), np.arange(len(keys))
        self.probes = 1
        while len(todo):
            slot = at[todo]
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            takes = np.zeros(len(todo), bool)
            takes[first] = True
            takes &= free
            won = todo[takes]
            self.keys[at[won]], self.rank[at[won]], self.merged[at[won]] = keys[won], rank[won], merged[won]
            todo = todo[~takes]
            at[todo] = (at[todo] + 1) & self.mask
            self.probes += bool(len(todo))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK if the pair is unknown) and merged id of flat id arrays; a negative id is padding."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._home(keys)
        found = self.keys[at]
        rank, merged = self.rank[at], self.merged[at]
        hit = found == keys
        rank = np.where(hit, rank, NO_RANK)
        open_ = np.flatnonzero(~hit & (found != np.uint64(2**64 - 1)) & (right >= 0) & (left >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[open_]
            rank[open_[hit]], merged[open_[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            go = ~hit & (found != np.uint64(2**64 - 1))
            open_, at = open_[go], at[go]
        return rank, merged

    def get(self, left: int, right: int) -> tuple[int, int] | None:
        key = (left << 32) | right
        at = ((key * int(_MULTIPLIER)) & (2**64 - 1)) >> int(self.shift)
        while (found := int(self.keys[at])) != key:
            if found == 2**64 - 1:
                return None
            at = (at + 1) & self.mask
        return int(self.rank[at]), int(self.merged[at])


class Merger:
    """Pair table and the ids of single bytes; encodes byte strings."""

    def __init__(self, table: PairTable, byte_ids: np.ndarray):
        self.table, self.byte_ids = table, byte_ids.astype(np.int32)

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> "Merger":
        """From a rank file: any two tokens whose joint bytes are a token merge, at that token's rank."""
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        got = np.array(rank, np.int32)
        return cls(PairTable(np.array(left, np.int64), np.array(right, np.int64), got, got),
                   np.array([ranks[bytes([i])] for i in range(256)]))

    @classmethod
    def of_merges(cls, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> "Merger":
        """From an ordered merge list: the rank of a pair is its place in the list."""
        col = lambda f: np.array([ids[f(m)] for m in merges], np.int64)
        return cls(PairTable(col(lambda m: m[0]), col(lambda m: m[1]), np.arange(len(merges), dtype=np.int32),
                             col(lambda m: m[0] + m[1]).astype(np.int32)),
                   np.array([ids[bytes([i])] for i in range(256)]))

    def encode(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each byte string, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(tokens)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                self._matrix([tokens[k] for k in rows[i:i + step].tolist()], rows[i:i + step], width, out)
            low = width
        for k in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            out[k] = self._long(tokens[k])
        return out

    def _matrix(self, tokens: list[bytes], rows: np.ndarray, width: int, out: list[bytes]) -> None:
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        width = int(size.max())
        ids = np.full((len(tokens), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        if width == 1:
            return self._emit(ids, size, rows, out)
        rank, merged = (x.reshape(-1, width - 1) for x in self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        while len(rows):
            best = rank.argmin(axis=1)                      # the leftmost of the least
            line = np.arange(len(rows))
            live = rank[line, best] != NO_RANK
            if not live.all():
                self._emit(ids[~live], size[~live], rows[~live], out)
                ids, rank, merged, size, rows, best = (x[live] for x in (ids, rank, merged, size, rows, best))
                line = line[:len(rows)]
            if not len(rows):
                return
            new, size = merged[line, best], size - 1
            width = int(size.max())
            move = np.arange(width) > best[:, None]
            kept = ids[:, :width]
            ids = np.where(move, ids[:, 1:width + 1], kept)
            ids[line, best] = new
            if width == 1:
                break
            gap = move[:, 1:]                               # pair j has its left end at place j
            rank, merged = (np.where(gap | (np.arange(width - 1) >= best[:, None]), x[:, 1:width], x[:, :width - 1])
                            for x in (rank, merged))
            for at in (best - 1, best):                     # only the two pairs at the new token change
                ok = np.flatnonzero((at >= 0) & (at < width - 1))
                p = at[ok]
                rank[ok, p], merged[ok, p] = self.table.find(ids[ok, p], ids[ok, p + 1])
        if len(rows):
            self._emit(ids, size, rows, out)

    @staticmethod
    def _emit(ids: np.ndarray, size: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        width = ids.shape[1] * 4
        flat = np.ascontiguousarray(ids.astype("<u4")).tobytes()
        begin = np.arange(len(rows)) * width
        for k, i, j in zip(rows.tolist(), begin.tolist(), (begin + 4 * size).tolist(), strict=True):
            out[k] = flat[i:j]

    def _long(self, token: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(token, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (got := self.table.get(ids[i], ids[j])):
                heapq.heappush(heap, (got[0], i, ids[i], ids[j], got[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()
