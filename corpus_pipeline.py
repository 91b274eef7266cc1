"""The corpus pipeline: documents in, token ids of the clean ones out.

Each stage calls one operator on all that the stage before it kept, is written
as Parquet under ``spark.checkpoint.dir`` and read again. All but the last
return the columns of ``documents`` as they came, also columns that an operator
uses as names of its own. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from routelens.llm.common import cut_lineage
from routelens.llm.op1_byte_bpe import digests
from routelens.llm.op3_decontaminate import drop_contaminated
from routelens.llm.op4_simhash import keep_one_of_near
from routelens.llm.op6_exact_dedup import keep_one_of_each
from routelens.llm.op8_quality import drop_low_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_near(docs, words=4, distance=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), words=5, limit=0.8)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL can't express the trained classifier, the fingerprints or the merges; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
