"""The registered queries of this folder and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .op10_licenses import document_licenses, oracle
from .op11_conversations import conversation_repair
from .op12_divergence import oracle as divergence_sql
from .op12_divergence import source_divergence
from .op13_pii import pii_spans
from .op1_byte_bpe import digests
from .op2_html import extract
from .op3_decontaminate import benchmark_matches
from .op4_simhash import near_duplicates
from .op5_language import language_id
from .op6_exact_dedup import exact_dedup
from .op7_token_counts import token_counts
from .op8_quality import quality_scores
from .op9_toxicity import toxicity_scores


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), words=5, limit=0.8)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4, distance=4)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir), folds=4, held_fold=2)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), folds=5, held_fold=0, threshold=0.3)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), folds=5, held_fold=0, threshold=0.5)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_licenses(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(documents(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir), min_docs=30, top=50)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_byte_bpe, op2_html_extraction, op3_decontamination, op4_simhash_near_dedup, op5_language_id, op6_exact_dedup,
    op7_token_counts, op8_quality, op9_toxicity, op10_license_scan, op11_conversation_repair, op12_source_divergence, op13_pii)}

ORACLE_SQL: dict[str, str] = {
    "op10_license_scan": oracle(),
    "op12_source_divergence": divergence_sql(),
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents),
             g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n) AS text_sha256
        FROM t JOIN g USING (n)""",
}
