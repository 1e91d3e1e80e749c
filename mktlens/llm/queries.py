"""The operators' queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_words, hard_negatives, html_wrappers, language_mix, license_scan, periodic_runs, quality_rules, shingle_join,
               source_mix, token_counts, token_files, url_filters, vector_topk)
from .common import scratch

END_ID = 2
TOKEN_LIMIT = 512


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(_table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.token_digests(spark, path)


def op2_bit_sliced_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vector_topk.top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf, "documents"))


def op4_language_mix(spark: SparkSession, sf: str) -> DataFrame:
    return language_mix.predict_languages(_table(spark, sf, "documents"))


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.prefix_steps(_table(spark, sf, "documents"), vocab, TOKEN_LIMIT, keep_steps=False)


def op6_shingle_join(spark: SparkSession, sf: str) -> DataFrame:
    return shingle_join.components(_table(spark, sf, "documents"), shingle=4, percent=85)


def op7_bpe_words(spark: SparkSession, sf: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_words.round_trip(_table(spark, sf, "documents"), vocab, public_tokenizers.PATTERN)


def op8_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return source_mix.taken_words(_table(spark, sf, "documents"))


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op10_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(_table(spark, sf, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


def op12_html_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    return html_wrappers.main_texts(_table(spark, sf, "pages"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_files, op2_bit_sliced_topk, op3_license_scan, op4_language_mix, op5_token_counts,
                            op6_shingle_join, op7_bpe_words, op8_source_mix, op9_quality_rules, op10_url_filters, op11_periodic_runs,
                            op12_html_wrappers, op13_hard_negatives)}
