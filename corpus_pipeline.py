"""From documents to token files: each stage works on all its predecessor kept.

ORACLE_SQL is None: SimHash, the classifier and the tokenizer aren't SQL; tests/llm compares the stages with plain versions.

Edge cases, for every stage: null texts are empty texts and null ids, sources and other columns are kept; an empty table stays empty; texts of any length are
worked on whole; bytes that aren't UTF-8 stay in rows that stay and count as U+FFFD where text is read; rows that repeat a doc_id are rows of their own until
near_dedup makes a group of equal texts one row; equal texts, or equal scores, are decided alike, and one of a group stays by the least doc_id; all but the last
stage return every column of documents, whatever its name. Token files are in ascending doc_id order, so the mix's amounts count there, not its slots' order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import mixing, near_dedup, token_orc, toxicity, wu_manber
from ledgerloom.llm.common import scratch
from ledgerloom.shipping import ship


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.unique(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wu_manber.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_orc.op10(spark, docs)


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _shipped(stage)) for name, stage in (("toxicity", detoxify), ("near_dedup", dedup), ("decontamination", decontaminate), ("mixing", mix), ("tokens", tokens))]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, df, sf_dir).write.parquet(path)
        df = spark.read.parquet(path)
    return STAGES[-1][1](spark, df, sf_dir)
