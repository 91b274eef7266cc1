"""Operator 12: how far the sources of a language differ in their words.

Terms are runs of letters A-Z (in lower case) and characters beyond ASCII. A
language keeps the terms that occur in at least ``min_docs`` of its documents;
each source, and the language, gives each kept term a smoothed share in
billionths, in whole numbers. Sources are compared by the sum of absolute
differences over all kept terms, and each source names the terms that it has
most beyond its language's share.

Strings are materialised late. Tasks count terms by a 64-bit digest, and only
(language, source, digest, counts) is shuffled, once, by language and digest;
the sums by source, the documents by language and the kept terms all follow
where the rows then lie. A second scan gives the least and the greatest string
of each kept digest; where they differ, several terms share the digest, and
these few are split: counted again by their text. Text is joined only to the
terms that can be in the result. Up to ``DIGESTS`` kept digests (counted first)
are broadcast, so that the second scan sends no string of another term; beyond
that, it is a join by digest.

Pairs: the kept terms of a language are dealt into blocks of bounded size, a
task fills the matrix of a block (sources by terms, a missing term has the
share of count 0) and adds up the differences for a tile of sources; a block
gives one number for each pair, never a row for each pair and term.

A row is a document, also where ids repeat. Null text, language and source are
''. A language without kept terms has distance 0 between its sources; one with a
single source has no pairs. Equal values rank by the item's UTF-8 bytes. An
empty table gives no rows. Other columns aren't read. The arithmetic is on
whole numbers, in decimals where a long could overflow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .common import cut_lineage, prepare, slices, utf8_of

MIN_DOCS = 30
TOP = 50
UNIT = 1_000_000_000
SMOOTH = 5
#: Kept digests that are broadcast at most: 8 bytes each.
DIGESTS = 1_000_000
#: Rows that a task holds before it hands them on.
HELD = 800_000
#: Cells of a matrix, least terms of a block, sources of a tile.
CELLS, LEAST_TERMS, TILE = 1 << 16, 256, 256

_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_runs(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(text number, code) of each term in page order, and the distinct terms that the codes name."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = np.concatenate([[False], _TERM[joined], [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = _LOWER[joined[inside[1:-1]]]
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.searchsorted(begins, starts, "right") - 1, terms.indices, terms.dictionary


def digests_of(terms: pa.Array, bits: int) -> np.ndarray:
    whole = np.fromiter((xxhash.xxh64_intdigest(t) for t in terms.to_pylist()), np.uint64, len(terms))
    return (whole >> np.uint64(64 - bits)).astype(np.int64)


class _Held:
    """Rows of a task, added up by key; at most ``most`` and those of a batch at a time."""

    def __init__(self, keys: list[str], sums: list[str], most: int) -> None:
        self.keys, self.sums, self.most, self.rows, self.size = keys, sums, most, [], 0

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.rows.append(table)
        self.size += len(table)
        if self.size > self.most:
            merged = self._merged()
            if len(merged) > self.most // 2:
                yield from merged.to_batches(max_chunksize=50_000)
                self.rows, self.size = [], 0
            else:
                self.rows, self.size = [merged], len(merged)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield from self._merged().to_batches(max_chunksize=50_000)

    def _merged(self) -> pa.Table:
        whole = pa.concat_tables(self.rows)
        if not self.sums:
            return whole.group_by(self.keys).aggregate([])
        out = whole.group_by(self.keys).aggregate([(s, "sum") for s in self.sums])
        return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select([*self.keys, *self.sums])


def counter(bits: int, spell: bool, most: int = HELD) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (lang, source, text) to (lang, source, digest[, split], n, docs)."""
    keys = ["lang", "source", "digest", *(["split"] if spell else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(keys, ["n", "docs"], most)
        for batch in batches:
            for part in slices(batch, "text", max_rows=100_000):
                number, codes, terms = term_runs(utf8_of(part.column("text")))
                if not len(terms):
                    continue
                # one row for each text and term, then for each group and term
                pairs, times = np.unique(number * len(terms) + codes.to_numpy(), return_counts=True)
                names = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], names=["lang", "source"])
                seen: dict[tuple[str, str], int] = {}
                group = np.array([seen.setdefault((x["lang"], x["source"]), len(seen)) for x in names.to_pylist()])
                cells, back = np.unique(group[pairs // len(terms)] * len(terms) + pairs % len(terms), return_inverse=True)
                n, docs = np.zeros(len(cells), np.int64), np.bincount(back, minlength=len(cells))
                np.add.at(n, back, times)
                who, which = cells // len(terms), cells % len(terms)
                langs, sources = (pa.array([x[i] for x in seen], pa.string()).take(pa.array(who)) for i in (0, 1))
                columns = {"lang": langs, "source": sources, "digest": digests_of(terms, bits)[which], "n": n, "docs": docs.astype(np.int64)}
                if spell:
                    columns["split"] = terms.take(pa.array(which)).cast(pa.string())
                yield from held.add(pa.table(columns).select([*keys, "n", "docs"]))
        yield from held.finish()

    return run


def dictionary(bits: int, most: int = HELD) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with a text to the distinct (digest, term) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(["digest", "term"], [], most)
        for batch in batches:
            for part in slices(batch, "text", max_rows=100_000):
                _, _, terms = term_runs(utf8_of(part.column("text")))
                yield from held.add(pa.table({"digest": digests_of(terms, bits), "term": terms.cast(pa.string())}))
        yield from held.finish()

    return run


def _share(n: Column, total: Column, terms: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    share = F.call_function("div", (wide(n) + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), wide(total) + wide(terms) * SMOOTH)
    return F.when(terms > 0, share + 1)


def kept_terms(docs: DataFrame, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, digest, split, n, n_lang, first) of kept terms with a count, and (digest, term) of their digests.
    ``split`` is '' or the term of a shared digest; ``first`` marks one row of each term."""
    by_term = Window.partitionBy("lang", "digest", "split")
    counted = "lang string, source string, digest long, n long, docs long"

    def kept(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("in", F.sum("docs").over(by_term)).withColumn("n_lang", F.sum("n").over(by_term))
                .withColumn("first", F.row_number().over(by_term.orderBy("source")) == 1).where(F.col("in") >= min_docs)
                .select("lang", "source", "digest", "split", "n", "n_lang", "first"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.repartition("lang", "digest").groupBy("lang", "digest", "split", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))

    rows = cut_lineage(kept(summed(docs.mapInArrow(counter(bits, False, HELD), counted).withColumn("split", F.lit("")))))
    wanted = bounded_broadcast(rows.where("first").select("digest").distinct(), DIGESTS)
    spelled = docs.select("text").mapInArrow(dictionary(bits, HELD), "digest long, term string").join(wanted, "digest", "left_semi")
    ends = cut_lineage(spelled.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")))
    shared = ends.where("term <> last").select("digest")
    if shared.isEmpty():
        return rows, ends.select("digest", "term")
    again = docs.mapInArrow(counter(bits, True, HELD), "lang string, source string, digest long, split string, n long, docs long")
    split = kept(summed(again.join(bounded_broadcast(shared, DIGESTS), "digest", "left_semi")))
    return cut_lineage(rows.join(shared, "digest", "left_anti").unionByName(split)), ends.where("term = last").select("digest", "term")


def _distances(key: tuple, sources: pd.DataFrame, shares: pd.DataFrame, size: int = TILE) -> pd.DataFrame:
    """Sums of absolute differences over a block's terms, of the tile's sources with all that come after them."""
    sources = sources.sort_values("number")
    columns = shares.groupby(["digest", "split"]).ngroup().to_numpy()
    matrix = np.repeat(sources["least"].fillna(0).to_numpy(np.int64)[:, None], columns.max(initial=-1) + 1, axis=1)
    matrix[shares["idx"].to_numpy(), columns] = shares["p"].to_numpy(np.int64)
    tile = range(key[2] * size, min(len(matrix), (key[2] + 1) * size))
    out = {"a": [np.full(len(matrix) - 1 - a, a) for a in tile], "b": [np.arange(a + 1, len(matrix)) for a in tile],
           "value": [np.abs(matrix[a + 1:] - matrix[a]).sum(axis=1) for a in tile]}
    out = {name: np.concatenate([np.zeros(0, np.int64), *parts]) for name, parts in out.items()}
    return pd.DataFrame({"lang": np.full(len(out["a"]), str(key[0]), object), **out})


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source",
                      text_col: str = "text", digest_bits: int = 64) -> DataFrame:
    """(lang, source, ``part``: pair or term, ``item``, ``value``, ``rank``)."""
    prepare(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept, texts = kept_terms(docs, min_docs, digest_bits)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("own"))
    by_lang = Window.partitionBy("lang")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total", "own"])
    groups = (groups.withColumn("terms", F.sum("own").over(by_lang)).withColumn("lang_total", F.sum("total").over(by_lang))
              .withColumn("sources", F.count(F.lit(1)).over(by_lang)).withColumn("idx", (F.row_number().over(by_lang.orderBy("source")) - 1).cast("int")))
    groups = cut_lineage(groups.withColumn("zero", _share(F.lit(0), F.col("total"), F.col("terms"))).withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / F.greatest(F.lit(LEAST_TERMS), F.floor(CELLS / F.col("sources")))).cast("int"))))
    known = bounded_broadcast(groups)
    shares = kept.join(known, ["lang", "source"]).select(
        "lang", "source", "idx", "sources", "digest", "split", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("n_lang"), F.col("lang_total"), F.col("terms")).alias("q"), F.pmod(F.xxhash64("digest", "split"), F.col("blocks")).cast("int").alias("block"))

    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / TILE).cast("int"))).alias("tile")
    # New names, since both sides of the groups below come from the table of sources.
    rows = groups.select("lang", "idx", "zero", "sources", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(
        F.col("lang").alias("of"), F.col("block").alias("at"), tiles, F.col("idx").alias("number"), F.col("zero").alias("least")).withColumnRenamed("tile", "part")
    cells = shares.select("lang", "block", tiles, "idx", "digest", "split", "p")
    size = TILE
    sums = (rows.groupBy("of", "at", "part").cogroup(cells.groupBy("lang", "block", "tile")).applyInPandas(
        lambda key, left, right: _distances(key, left, right, size), "lang string, a int, b int, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way"), "value")
    name = lambda end, out: known.select("lang", F.col("idx").alias(end), F.col("source").alias(out))
    pairs = both.select("lang", "way.a", "way.b", "value").join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    by_group = Window.partitionBy("lang", "source")
    ranked = by_group.orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    beyond = shares.where("p > q").select("lang", "source", "digest", "split", (F.col("p") - F.col("q")).alias("value"))
    likely = beyond.withColumn("place", F.rank().over(by_group.orderBy(F.desc("value")))).where(F.col("place") <= top)     # ties stay until their text is known
    spelled = likely.join(texts, "digest", "left").select("lang", "source", F.when(F.col("split") == "", F.col("term")).otherwise(F.col("split")).alias("item"), "value")
    terms = spelled.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def oracle() -> str:
    """The same in DuckDB SQL, by the strings."""
    return rf"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
        occ AS (SELECT lang, source, doc, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        per AS (SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM (SELECT lang, source, doc, term, count(*) AS n FROM occ GROUP BY ALL) GROUP BY lang, source, term),
        kept AS (SELECT lang, term, sum(n) AS n FROM per GROUP BY lang, term HAVING sum(docs) >= {MIN_DOCS}),
        grp AS (SELECT DISTINCT lang, source FROM d),
        cells AS (SELECT g.lang, g.source, k.term, coalesce(p.n, 0) AS n FROM grp g JOIN kept k ON g.lang = k.lang
                  LEFT JOIN per p ON p.lang = g.lang AND p.source = g.source AND p.term = k.term),
        tot AS (SELECT lang, source, sum(n) AS total, count(*) AS terms FROM cells GROUP BY ALL),
        share AS (SELECT c.lang, c.source, c.term, c.n, 1 + (CAST({UNIT} AS HUGEINT) * (c.n + {SMOOTH})) // (t.total + {SMOOTH} * t.terms) AS p
                  FROM cells c JOIN tot t ON c.lang = t.lang AND c.source = t.source),
        whole AS (SELECT lang, sum(n) AS total, count(*) AS terms FROM kept GROUP BY lang),
        lang_share AS (SELECT k.lang, k.term, 1 + (CAST({UNIT} AS HUGEINT) * (k.n + {SMOOTH})) // (w.total + {SMOOTH} * w.terms) AS q FROM kept k JOIN whole w ON k.lang = w.lang),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - l.q AS value FROM share s JOIN lang_share l ON s.lang = l.lang AND s.term = l.term WHERE s.n > 0 AND s.p > l.q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
