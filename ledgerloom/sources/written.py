"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder on local masters only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.gettempdir() + "/ledgerloom"
    return at.rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """Tables of a loop, under one folder; each is read back with its schema, and those that later ones replace are removed."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.live = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame) -> DataFrame:
        return self.counted(df)[0]

    def counted(self, df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
        """The table and aggregates of its rows, which are taken as they are written."""
        path = f"{self.folder}/{len(self.live)}"
        self.live[path] = True
        seen = Observation()
        (df.observe(seen, *[c.alias(k) for k, c in sums.items()]) if sums else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out, seen.get if sums else {}

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_written_at", None)
            if path and self.live.get(path):
                self.live[path] = False
                discard(self.spark, path)
