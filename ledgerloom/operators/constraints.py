"""Constraints over relations as reports of what breaks them: (rule, key, n), empty where they hold. Nothing is collected; require() stops a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Broken(ValueError):
    """A constraint that doesn't hold."""


def _key(cols: list[str]) -> Column:
    return F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("key")


def unique(df: DataFrame, cols: list[str], rule: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), _key(cols), "n")


def determines(df: DataFrame, cols: list[str], value: str, rule: str) -> DataFrame:
    """Keys with more than one value: cols must determine it. Distinct rows come first, so a frequent key is summed where its rows lie."""
    pairs = df.select(*cols, F.col(value).alias("_v")).filter("_v IS NOT NULL").distinct()
    return pairs.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), _key(cols), "n")


def refers(child: DataFrame, fk: str, parent: DataFrame, pk: str, rule: str) -> DataFrame:
    """Values of fk that no pk has; nulls refer to nothing."""
    values = child.groupBy(F.col(fk).alias("_k")).agg(F.count("*").alias("n")).filter("_k IS NOT NULL")
    return values.join(parent.select(F.col(pk).alias("_k")), "_k", "left_anti").select(F.lit(rule).alias("rule"), F.col("_k").cast("string").alias("key"), "n")


def holds(df: DataFrame, cols: list[str], test: Column, rule: str) -> DataFrame:
    """Rows for which the test isn't true."""
    return df.filter(~F.coalesce(test, F.lit(False))).groupBy(*cols).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), _key(cols), "n")


def together(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def require(report: DataFrame, shown: int = 5) -> None:
    """Stops if the report has rows, naming a few of them."""
    if rows := report.limit(shown).collect():
        raise Broken("; ".join(f"{r.rule}: {r['key']} ({r.n})" for r in rows))
