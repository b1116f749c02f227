"""The corpus operators' queries, with production parameters over whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, htmltext, langid, linededup, mixing, naivesvm, ngramjoin, quality, resampling, secrets, unitdedup, vafile, variants
from tessella.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.group(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitdedup.removals(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_increments(table(spark, sf_dir, "documents")))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op12_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naivesvm.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_html_text, op3_source_mixing, op4_line_dedup, op5_quality, op6_ngram_jaccard, op7_language_id, op8_unit_dedup, op9_secret_scan, op10_exact_topk, op11_spelling_variants, op12_quality_nbsvm, op13_target_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.oracle(), "op6_ngram_jaccard": ngramjoin.ORACLE, "op10_exact_topk": vafile.ORACLE, "op11_spelling_variants": variants.ORACLE, "op13_target_resampling": resampling.ORACLE}
