"""Operator 10: token ids in ORC files.

Documents are dealt by ranges of doc_id, encoded where they land and written as ORC: integer run-length encoding for every column, row index
entries each `row_index_stride` rows, Bloom filters on doc_id. Files hold consecutive ranges of ids, so a reader prunes files and stripes by their
statistics, and reads stripes in parallel. No text moves but in that one exchange.

Edge cases: a null text is empty and yields the end id alone; null doc_ids come first; rows that repeat a doc_id are ordered by their text's hash,
equal rows are interchangeable; bytes that aren't UTF-8 count as U+FFFD; a text of any length is one row; an empty table yields files without rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, own_text, scratch, small_table, text_batches, text_parts
from .encoding import array_slices, encoder, vocabulary_path

FILE_SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"


def _encode(batches: Iterator[pa.RecordBatch], file: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, before, enc = TaskContext.get().partitionId(), 0, encoder(file)
    for b in batches:
        for lo, hi in array_slices(b.column(1)):
            ids, at = enc.encode_array(b.column(1).slice(lo, hi - lo))
            values = np.insert(ids, at[1:], end_id).astype(np.int32)
            at = at + np.arange(len(at))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(before + at[:-1]), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            before += int(at[-1])
    give_back()


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, stripe_bytes: int = 64 << 20, row_index_stride: int = 1000, partitions: int | None = None) -> str:
    """Writes the ids of every document in ascending doc_id order under path; returns path."""
    text_batches(docs.sparkSession)
    file = vocabulary or vocabulary_path()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_text().cast("binary").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    dealt = narrow.repartitionByRange(partitions or text_parts(narrow), *order).sortWithinPartitions(*order)
    tokens = dealt.mapInArrow(lambda it: _encode(it, file, end_id), FILE_SCHEMA)
    (
        tokens.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride)).option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").orc(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, part, part_start, n_tokens, ids) of the files; doc_ids, if given, prunes files, stripes and row groups by statistics and Bloom filters."""
    table = spark.read.schema(FILE_SCHEMA).orc(path)
    return table if doc_ids is None else table.filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(3)
        values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone. The prefix sums over parts have a row for each file."""
    sums = sorted((r["part"], r["n"]) for r in read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    rows = read_tokens(spark, path).select("doc_id", "part", "part_start", "ids").mapInArrow(_digest, "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    base = small_table(spark, starts, "part int, base bigint")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def op10(spark: SparkSession, docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the files, then returns the digests read back from them."""
    return digests(spark, write_tokens(docs, path or scratch(spark, "tokens"), **options))
