"""A corpus pipeline over documents: quality, repeated lines, near copies, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever others there are.
The last adds each document's place in the mixture as columns mix_block, mix_slot and mix_position, as a table that is read again doesn't
keep the order of its rows: sorting by mix_position gives the mixture. Near copies are those of the default, five words and a similarity of 0.8 or
more. Documents that hold a benchmark window go as a whole. No SQL can state the first stage, whose model is trained, so ORACLE_SQL is
None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeworks.llm import common, decontaminate, line_dedup, mixing, near_join, quality_fm


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_fm.stage(docs, common.table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.stage(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one(docs, k=5, num=80, den=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.stage(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.places(docs)


STAGES = [("quality", quality), ("repeated_lines", repeated_lines), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("mixture", mixture)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again by the next."""
    docs, tables = common.table(spark, sf_dir, "documents"), common.Tables(spark)
    for _, stage in STAGES:
        docs = tables.cut(stage(spark, docs, sf_dir), drop=(docs,))
    return docs
