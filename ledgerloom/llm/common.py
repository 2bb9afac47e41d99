"""What the operators share: the shared folder, written tables, numbering rows over a sorted table."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in the contracts are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of this machine on local masters only."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is dealt and sorted, never broadcast, as a broadcast table passes whole through the driver."""
    return df.hint("merge")


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of scratch() that a later one replaces."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Written tables of one operator, which go once those that come after them are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str, *partitions: str) -> DataFrame:
        self.paths.append(scratch(self.spark, tag))
        df.write.partitionBy(*partitions).parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []


def parallelism(spark: SparkSession, rows: int = 0, each: int = 4_000_000) -> int:
    """The session's shuffle partitions, or more where rows would be more than `each` to a task."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // each))


def text_parts(df: DataFrame, each: int = 256 << 20) -> int:
    """How many tasks texts of df are dealt to: the session's shuffle partitions, or more where the files that df reads would give over `each` stored
    bytes to a task. Sources whose size Spark doesn't know (rows made on the driver) count as small."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    return parallelism(df.sparkSession, sum(n for n in sizes if n < 1 << 62), each)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before each as make it none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def own_text(column: str = "text") -> Column:
    """A text as valid UTF-8; bytes that are none become U+FFFD."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """A column of texts as bytes, valid UTF-8 or not."""
    return column.cast(pa.binary()).to_pylist()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first `keys` columns, a batch or more at a time: rows of one key come together, a key that may go on waits."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if held[0] is not b and all(held[0].column(i)[0] == b.column(i)[-1] for i in range(keys)):
            continue
        t = pa.Table.from_batches(held)
        cols = [t.column(i).to_numpy() for i in range(keys)]
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        cut = int(np.argmax(same)) if same.any() else len(same)
        if cut:
            yield [c.to_numpy() for c in t.slice(0, cut).columns]
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def text_batches(spark: SparkSession, most: str = "8m") -> None:
    """Batches of texts that go to Python hold at most this many bytes, however long texts are (a batch has one row at least)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def give_back() -> None:
    """At the end of a task: memory that a Python worker no longer uses goes back to the system, as workers are used again by other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(batches: Iterator[pa.RecordBatch], key: int | None, value: int) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and, by key, the sum of value over the rows before each row of it."""
    pid, before = TaskContext.get().partitionId(), {}
    for b in batches:
        v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
        if key is None:
            codes, names = np.zeros(len(v), np.int64), [0]
        else:
            d = b.column(key).dictionary_encode(null_encoding="encode")
            codes, names = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()
        order = np.argsort(codes, kind="stable")
        c, s = codes[order], v[order]
        sums = np.cumsum(s) - s
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
        length = np.diff(np.r_[first, len(c)])
        start = np.array([before.get(names[k], 0) for k in c[first]], np.int64)
        out = np.empty(len(v), np.int64)
        out[order] = sums + np.repeat(start - sums[first], length)
        for k, i, n in zip(c[first], first, length):
            before[names[k]] = before.get(names[k], 0) + int(s[i : i + n].sum())
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(len(v), pid, np.int32)), pa.array(out)], names=[*b.schema.names, "_part", "_before"]
        )


def running_sums(df: DataFrame, value: str, key: str | None, tag: str) -> tuple[DataFrame, dict]:
    """For a df that is dealt and sorted: the written table with _part and _before (sum of value over the rows of the same key before it in its
    partition), and {(part, key): sum}. The dict has a row for each partition and key in it; for sorted keys at most partitions + keys."""
    spark, i = df.sparkSession, df.columns.index(value)
    k = None if key is None else df.columns.index(key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    table = written(df.mapInArrow(lambda it: _running(it, k, i), f"{fields}, _part int, _before bigint"), tag)
    by = ["_part"] if key is None else ["_part", key]
    sums = table.groupBy(*by).agg(F.sum(value).cast("long").alias("_sum"), F.count("*").alias("_rows")).collect()
    return table, {(r["_part"], None if key is None else r[key]): (r["_sum"] or 0, r["_rows"]) for r in sums}


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """Dealt by ranges of the order and sorted in each; Spark deals by a sample, so equal leading columns spread over several partitions."""
    return df.repartitionByRange(text_parts(df), *order).sortWithinPartitions(*order)


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table made on the driver from rows whose number is bounded by the caller's parameters."""
    return spark.createDataFrame(rows, schema)
