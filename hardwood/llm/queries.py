"""The queries opN_<name> over whole tables, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import divergence_audit, mixing, url_filter, vector_codes, warc
from .decontaminate import contamination
from .kneser_ney import held_out_scores
from .language_id import held_out_languages
from .line_dedup import line_report
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_groups
from .quality_rules import judge_quality
from .secret_scan import secret_digests
from .substring_dedup import substring_digests
from .url_filter import judge_urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(_read(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_groups(_read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_read(spark, sf_dir, "documents"), "doc_id")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_read(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.divergence_audit(_read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(_read(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_ngram_jaccard_join, op4_secret_scan, op5_url_filter,
                                   op6_source_mixing, op7_quality_cascade, op8_kneser_ney, op9_substring_dedup, op10_line_dedup,
                                   op11_source_divergence, op12_vector_codes, op13_warc)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE: dict[str, str] = {"op5_url_filter": url_filter.SQL, "op6_source_mixing": mixing.SQL,
                          "op11_source_divergence": divergence_audit.SQL, "op12_vector_codes": vector_codes.SQL, "op13_warc": warc.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
