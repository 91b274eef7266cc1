"""Operator 7: token counts of whole texts by the whole-token shortcut.

Offline (once per vocabulary, on the driver) every vocabulary string is run
through the merges; those that come out as the one token itself are the proven
whole tokens. A pre-token equal to one of them counts as one without merging;
only the rest are merged. The strings of special tokens inside a text count as
one token each and cut the text, as the library does by default.

Null and empty texts have 0 bytes and 0 tokens; a null ``doc_id`` and repeated
rows pass through, a row for each input row; other columns aren't read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger
from .common import prepare, slices, texts_of
from .pretokens import BYTE_LEVEL_PATTERN, Cutter

#: Merged pre-tokens whose counts a worker remembers, at most, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabulary files:
    printable Latin-1 bytes stand for themselves, the rest for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, proven whole tokens and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if (spec["model"]["type"], pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space"), spec.get("normalizer")) != ("BPE", "ByteLevel", True, False, None):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        at = byte_symbols()
        raw = lambda s: bytes(at[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in set(self.special)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = [(raw(a), raw(b)) for a, b in merges]
        self.whole = self._proven()

    def merger(self) -> Merger:
        return Merger.of_merges(self.ids, self.merges)

    def _proven(self) -> set[bytes]:
        tokens = list(self.ids)
        alone = self.merger().encode(tokens)
        return {t for t, got in zip(tokens, alone, strict=True) if got == self.ids[t].to_bytes(4, "little")}


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.cut = Cutter(BYTE_LEVEL_PATTERN).cut
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.merger = vocabulary.merger()
        self.whole = {t.decode(): 1 for t in vocabulary.whole if _is_utf8(t)}
        self.known = dict(self.whole)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.known) > REMEMBERED + len(self.whole):
            self.known = dict(self.whole)
        parts = [self.special.split(t) for t in texts] if self.special else [[t] for t in texts]
        tokens, at = self.cut([p for ps in parts for p in ps])
        known = self.known
        rest = [t for t in set(tokens) if t not in known]
        known.update((t, len(x) // 4) for t, x in zip(rest, self.merger.encode([t.encode("utf-8", "replace") for t in rest]), strict=True))
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))])
        for t in rest:
            if len(t) > LONGEST:
                del known[t]
        pieces = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(pieces)
        return (upto[at[ends]] - upto[at[ends - pieces]] + pieces - 1).tolist()


def _is_utf8(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_bytes``, ``n_tokens``, ``over_limit``) for each row."""
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(vocabulary.value)
        for batch in batches:
            for part in slices(batch, "text"):
                n_bytes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                n = _COUNTERS[path].count(texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), n_bytes, pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
            .withColumn("over_limit", F.col("n_tokens") > limit))
