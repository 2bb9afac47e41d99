"""Canonical JSON, hashes and strict readers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value) -> str:
    """Sorted keys, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def framed_hash(parts: list[str]) -> str:
    """Each part with its length before it, so no two lists run together alike."""
    h = hashlib.sha256()
    for p in parts:
        b = p.encode()
        h.update(len(b).to_bytes(8, "big") + b)
    return h.hexdigest()


def row_hash(*columns: Column) -> Column:
    """SHA-256 of a row's canonical JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def corpus_fingerprint(hashes: DataFrame, column: str, version: str) -> DataFrame:
    """One row: a fingerprint that doesn't depend on the order of rows. Rows are hashed into 4096 groups first, so no task gathers all of them;
    rows without a hash are a group of their own, and their number counts."""
    grouped = hashes.groupBy(F.conv(F.substring(column, 1, 3), 16, 10).cast("int").alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.coalesce(column, F.lit("")))), ",").cast("binary"), 256).alias("h"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ",")
    return grouped.agg(F.sha2(F.concat(F.lit(version + ":"), top).cast("binary"), 256).alias("fingerprint"))


def strict_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV whose header is exactly the schema's; ragged or malformed lines are errors."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Lines of canonical JSON: columns in alphabetical order, nulls kept."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", False).json(path)


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files under path joined with expected (name, sha256): name, sha256, status ok, drift or unknown."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("found") == F.col("sha256"), "ok").otherwise("drift")
    return found.join(expected, "name", "full_outer").withColumn("status", status)
