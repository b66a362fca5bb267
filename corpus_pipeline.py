"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hardwood.llm.decontaminate import drop_contaminated
from hardwood.llm.language_id import keep_determined
from hardwood.llm.line_dedup import dedup_lines
from hardwood.llm.mixing import mix_sources
from hardwood.llm.ngram_join import keep_one
from hardwood.llm.storage import discard, materialize

#: SQL cannot train the network, nor decide near copies of lines; tests hold run() against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a determined language; ``lang`` is the prediction."""
    return keep_determined(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that another line stands for; documents left without lines go."""
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8."""
    return keep_one(docs, n=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target weight, in global order; adds ``replica`` and ``mix_order``."""
    return mix_sources(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mixture", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; a stage's table is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
