"""The pipeline against its operators applied one by one, by hand where that is exact."""
import hashlib
import struct
import shutil

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from routelens.llm.op1_byte_bpe import read_ranks
from routelens.llm.op8_quality import quality_scores

from .test_decontaminate import by_hand
from .test_duplicates import exact_by_hand, near_by_hand

D = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality_scores(docs, spark.read.parquet(f"{D}/labels.parquet")).collect() if r["predicted"]}
    rows = [(i, texts[i]) for i in sorted(good)]
    kept = {r[0] for r in exact_by_hand(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    rows = [r for r in rows if r[0] in {c for _, _, c in near_by_hand(rows)}]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    leaks = {d for d, _ in by_hand(rows, items)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in rows:
        if i not in leaks:
            ids = enc.encode_ordinary(t)
            want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, D).collect())) == want and len(want) > 100


def test_stages_keep_columns(spark, make, tmp_path):
    for t in ("labels", "benchmark"):
        shutil.copy(f"{D}/{t}.parquet", tmp_path / f"{t}.parquet")
    for docs in (make([(1, "some text here"), (1, "some text here"), (2, None), (None, "x"), (3, "")]), make([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            out.collect()
