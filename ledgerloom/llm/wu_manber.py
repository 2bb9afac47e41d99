"""Operator 9: benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words. Patterns are the windows of 10 consecutive item words (an item of fewer words is one pattern). Patterns of one length share a
searcher: a shift table over blocks of two words says how far the window may jump, a block with shift zero names a bucket of patterns with that
suffix, and direct comparison of the words confirms an occurrence. Text of no pattern is passed in jumps of up to nine words.

The pattern tables are broadcast in groups of at most `max_patterns` windows (tables take about 1 kB of a worker's memory for each: 260 MB, measured); a
larger benchmark takes several passes over the documents, each with one group, which write the texts in between; the hit words of all passes are united, so
results don't depend on the bound. Nothing is shuffled.

Edge cases: null texts and ids are kept (a null text has no words; windows of an item without an id hit words, only the items leave it out); an item without
words has no window; items with equal windows all count; repeated document rows are separate rows, repeated item rows count once by item_id; texts of any
length are searched whole, bytes that aren't UTF-8 are letters as any byte from 128 on; empty tables give no rows, or no hits; other columns, whatever their
names, are ignored by find() and kept by clean().
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches, text_bytes, written

#: Words: digits, letters (A-Z lower-cased) and all bytes of code points from U+0080; everything else separates.
TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
WINDOW = 10


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Searcher:
    """Wu-Manber over word sequences of one length m, in blocks of two words (of one, where m is 1)."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], m: int):
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(dict)
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                key = p[end - 2 : end] if self.block == 2 else p[end - 1]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            self.buckets[p[m - 2 : m] if self.block == 2 else p[m - 1]][p] = items
        self.buckets = dict(self.buckets)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence, by start."""
        m, n, default, shift, pair = self.m, len(words), self.default, self.shift.get, self.block == 2
        i = m - 1
        while i < n:
            key = (words[i - 1], words[i]) if pair else words[i]
            jump = shift(key, default)
            if jump:
                i += jump
                continue
            found = self.buckets[key].get(tuple(words[i - m + 1 : i + 1]))
            if found is not None:
                yield i - m + 1, found
            i += 1


def searchers(items: list[tuple[int, bytes]], size: int = WINDOW) -> list[Searcher]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        for w in windows_of(words_of(text), size):
            by_length[len(w)][w].add(item)
    return [Searcher({p: sorted(s, key=lambda x: (x is None, x)) for p, s in group.items()}, m) for m, group in sorted(by_length.items())]


def hits(words: list[bytes], search: list[Searcher]) -> tuple[list[tuple[int, int]], set[int]]:
    """Disjoint ascending intervals of hit words, and the ids of the items that occur."""
    spans, items = [], set()
    for s in search:
        for start, found in s.search(words):
            spans.append((start, start + s.m))
            items.update(found)
    items.discard(None)
    if not spans:
        return [], items
    spans.sort()
    out = [spans[0]]
    for a, b in spans[1:]:
        if a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out, items


def benchmark_groups(benchmark: DataFrame, max_patterns: int, size: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items in groups of about max_patterns windows; only one group is on the driver at a time. An item with more windows than that is a group."""
    group, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary")).filter(F.col("text").isNotNull())
    for item, text in rows.orderBy("item_id").toLocalIterator():
        text = bytes(text)
        k = len(windows_of(words_of(text), size))
        if group and n + k > max_patterns:
            yield group
            group, n = [], 0
        group.append((item, text))
        n += k
    yield group


def _tables(handle, size: int) -> list[Searcher]:
    items = handle.value
    cached = _TABLES.get("one")
    if cached is None or cached[0] is not items:
        _TABLES["one"] = cached = (items, searchers(items, size))
    return cached[1]


_TABLES: dict = {}


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_patterns: int = 250_000) -> DataFrame:
    """One row for each document: doc_id, n_words, spans (hit intervals of words, end exclusive), items (ids with occurring windows, ascending)."""
    spark = docs.sparkSession
    text_batches(spark)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    schema = "doc_id bigint, text binary, n_words bigint, spans array<struct<start:int,end:int>>, items array<bigint>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def one_pass(handle, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _tables(handle, size)
            for b in batches:
                n, spans, items = [], [], []
                before = None if first else b.column(3).to_pylist()
                known = None if first else b.column(4).to_pylist()
                for k, text in enumerate(b.column(1).to_pylist()):
                    words = words_of(text)
                    s, found = hits(words, search)
                    if not first:
                        s, found = unite([(x["start"], x["end"]) for x in before[k]] + s), found | set(known[k])
                    n.append(len(words))
                    spans.append([{"start": x, "end": y} for x, y in s])
                    items.append(sorted(found))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "text", "n_words", "spans", "items"])

        return run

    first = True
    for group in benchmark_groups(benchmark, max_patterns, size):
        if not first:
            df = written(df, "passes")  # so workers hold the tables of one group at a time
        df = df.mapInArrow(one_pass(spark.sparkContext.broadcast(group), first), schema)
        first = False
    return df.drop("text")


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_patterns: int = 250_000) -> DataFrame:
    """The documents without an occurrence, every column as it was."""
    spark, names = docs.sparkSession, docs.columns
    text_batches(spark)
    at = names.index("text")

    def keep(handle):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _tables(handle, size)
            for b in batches:
                mask = [not any(True for s in search for _ in s.search(words)) for words in map(words_of, text_bytes(b.column(at)))]
                yield b.filter(pa.array(mask, pa.bool_()))

        return run

    out = docs
    for i, group in enumerate(benchmark_groups(benchmark, max_patterns, size)):
        if i:
            out = written(out, "passes")
        out = out.mapInArrow(keep(spark.sparkContext.broadcast(group)), docs.schema)
    return out


def op9(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of find()."""
    found = find(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]).cast("long"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: DuckDB: windows of items against windows of documents, word by word.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM p),
dw AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
       FROM (SELECT rid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lens WHERE len(w) >= m)),
occ AS (SELECT DISTINCT dw.rid, dw.i, dw.m, p.item_id FROM dw JOIN p ON p.m = dw.m AND p.win = dw.win),
hit AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS j FROM occ) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM occ GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
