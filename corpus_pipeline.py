"""The corpus pipeline: quality, near duplicates, benchmark copies, source mix, token files.

Each stage works on all rows that the one before it kept, which are written as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklake.llm import decontam, mix, ngrams, quality, tokens
from tracklake.llm.common import fresh_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak supervision keeps; rejected ones go."""
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngrams.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken."""
    return mix.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: a row for each document taken."""
    return tokens.read_tokens(tokens.write_tokens(docs))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_decontamination", benchmark_decontamination), ("source_mix", source_mix), ("token_output", token_output)]

#: Fitted rules, connected components and token files are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the Parquet of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
