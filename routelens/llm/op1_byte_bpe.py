"""Operator 1: byte-level BPE encoding and decoding of whole texts.

Null and empty texts have no ids and decode to nothing; a null ``doc_id`` and
repeated rows pass through, a row for each input row; other columns aren't
read, so their names can't clash. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger
from .common import prepare, slices, texts_of
from .pretokens import Cutter

#: Encoded pre-tokens that a worker remembers, at most, and the longest of them: so some 100 MB at most.
REMEMBERED, LONGEST = 300_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for a rank file; texts are cut into pre-tokens by ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.cut = Cutter(pattern).cut
        self.merger = Merger.of_ranks(ranks)
        self.known: dict[str, bytes] = {}
        by_id = dict(zip(ranks.values(), ranks.keys(), strict=True))
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        tokens, at = self.cut(texts)
        new = [t for t in set(tokens) if t not in known]
        known.update(zip(new, self.merger.encode([t.encode("utf-8", "replace") for t in new]), strict=True))
        ids, at = list(map(known.__getitem__, tokens)), at.tolist()
        for t in new:
            if len(t) > LONGEST:
                del known[t]
        return [b"".join(ids[i:j]) for i, j in zip(at, at[1:], strict=False)]

    def decode(self, ids: bytes, step: int = 1 << 18) -> bytes:
        """The bytes that the ids stand for."""
        every, out = np.frombuffer(ids, "<u4").astype(np.int64), []
        for i in range(0, len(every), step):
            x = every[i:i + step]
            n = self.length[x]
            end = np.cumsum(n)
            at = np.repeat(self.offset[x] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)
            out.append(self.bytes[at].tobytes())
        return b"".join(out)


_CODECS: dict[int, Codec] = {}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids`` binary of little-endian uint32, ``decoded`` binary) for each row."""
    spark = docs.sparkSession
    prepare(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    key = hash((ranks_path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _CODECS:
            _CODECS[key] = Codec(ranks.value, pattern)
        codec = _CODECS[key]
        for batch in batches:
            for part in slices(batch, "text"):
                ids = codec.encode(texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())],
                    names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The contract's columns: counts and digests of the ids and of the decoded bytes."""
    out = encode_decode(docs, ranks_path, pattern)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
