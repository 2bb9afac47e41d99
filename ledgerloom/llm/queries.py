"""Queries of this subpackage for the driver, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cross_entropy, filter_audit, importance, merkle, mixing, resharding, secrets, simhash, suffix_levels, token_orc, toxicity, warc, wu_manber


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_warc_derivatives": lambda s, d: warc.op1(s, _table(s, d, "pages")),
    "op2_mix_sources": lambda s, d: mixing.op2(s, _table(s, d, "documents")),
    "op3_secret_scan": lambda s, d: secrets.op3(s, _table(s, d, "documents")),
    "op4_reshard": lambda s, d: resharding.op4(s, _table(s, d, "documents")),
    "op5_cross_entropy": lambda s, d: cross_entropy.op5(s, _table(s, d, "documents"), _table(s, d, "labels")),
    "op6_toxicity": lambda s, d: toxicity.op6(s, _table(s, d, "documents"), _table(s, d, "labels")),
    "op7_simhash": lambda s, d: simhash.op7(s, _table(s, d, "documents")),
    "op8_merkle": lambda s, d: merkle.op8(s, _table(s, d, "documents")),
    "op9_decontaminate": lambda s, d: wu_manber.op9(s, _table(s, d, "documents"), _table(s, d, "benchmark")),
    "op10_token_orc": lambda s, d: token_orc.op10(s, _table(s, d, "documents")),
    "op11_suffix_levels": lambda s, d: suffix_levels.op11(s, _table(s, d, "documents")),
    "op12_importance": lambda s, d: importance.op12(s, _table(s, d, "documents"), _table(s, d, "benchmark")),
    "op13_filter_audit": lambda s, d: filter_audit.op13(s, _table(s, d, "documents"), _table(s, d, "labels")),
}

ORACLES = {"op9_decontaminate": wu_manber.ORACLE, "op12_importance": importance.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
