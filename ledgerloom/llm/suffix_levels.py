"""Repeated passages by a logarithmic family of suffix arrays: every byte that a string of `length` bytes covers which also starts elsewhere.

A suffix array of every byte would hold eight bytes for each byte of text, fourteen times the stored input, so the arrays are sampled. In each window of `length` bytes the
string of `name` bytes with the least hash, the leftmost of equals, is the window's anchor; equal windows have their anchors at the same place, so suffixes that
start at anchors, about one in sixty, are enough. A suffix stands in its array by the hash of its first `name` bytes, its name: that brings equal prefixes together, which is all
that matching asks, and is not their order as bytes.

Levels: a new batch of suffixes becomes a sorted array of names with their numbers of places. It is merge-scanned against every level for names that both hold (a sort-merge join
of arrays in which a name stands once); levels of equal size merge into one of the next size, and a merge finds common names on the way, so n batches leave log n levels and each suffix is
rewritten log n times.

From names to bytes, without a pair of places ever being made:

1. A run is the windows that share one anchor; its content is their whole span. Runs under names that stand more than once are grouped by content: where two places have one content
   all their windows are repeated.
2. One place stands for each content. Where a name has several contents some windows may still agree: they are split by their distance from the anchor into blocks of 32, grouped
   by the bytes that a block's windows have in common, and then by the block's content.
3. Windows of the blocks still open are compared one by one, by hash.

What joins meet is written before, as adaptive execution splits a skewed key only where nothing but a sort stands between exchange and join. All counts are partial sums, so a passage that a third of all documents holds is one row for each task that saw it; joins that take places to their marks have such a passage as a skewed
key on one side, which adaptive execution splits (spark.sql.adaptive.skewJoin, on by default). What decides has two hashes, 128 bits. Texts move once to give the bytes of one place for each
content, and once to lose their spans; only the documents concerned, while their keys (8 bytes each) are at most `sent`, else all texts.

Edge cases: a null text is an empty one; texts shorter than `length` stay whole; matches never cross documents; the same document counts as elsewhere, overlapping too, so
a run of one letter goes but for nothing; rows that repeat doc_id and text are each other's copies and all go; a null doc_id is an id like others; bytes that aren't UTF-8 are compared as they
are; an empty table stays empty. Only doc_id and text are read, so other columns may have any name. Texts of any length are read whole, in blocks of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, discard, give_back, scratch, text_batches, text_bytes, written

LENGTH, NAME = 200, 64
#: Windows hashed at once, and the low bits of a packed hash that hold a place among them.
BLOCK, PLACE = 1 << 18, 20
#: Windows of a block of the second grouping, by their distance from the anchor.
STEP = 32
#: Keys (8 bytes each) up to which the documents concerned are picked by a broadcast.
SENT = 1_000_000
BASE = 0x9E3779B97F4A7C15
RUN = "key bigint, at bigint, name bigint, content bigint"


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Of a row: rows alike in id and text have one key, as they have one result."""
    return F.xxhash64(F.col(doc_id).isNull(), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


class Hasher:
    """Hashes of all strings of `size` bytes of an array, by sums of random letter values times powers, modulo 2^64, stirred."""

    def __init__(self, most: int):
        self.letters = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, np.uint64)
        self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(most, b, np.uint64)]) for b in (BASE, pow(BASE, -1, 1 << 64)))

    def __call__(self, data: np.ndarray, size: int) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * self.down[: len(data) - size + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def least(key: np.ndarray, width: int) -> np.ndarray:
    """Of each `width` neighbours the least."""
    n, span = len(key) - width + 1, 1
    while span * 2 <= width:
        key, span = np.minimum(key[:-span], key[span:]), span * 2
    return np.minimum(key[:n], key[width - span : width - span + n])


def runs_of(data: np.ndarray, inside: np.ndarray, hasher: Hasher, length: int, name: int) -> Iterator[tuple[np.ndarray, ...]]:
    """First window, number of windows, first window's distance to the anchor, name: of each run of consecutive windows that lie inside a text and share an anchor."""
    low = np.uint64((1 << PLACE) - 1)
    for lo in range(0, len(inside), BLOCK):
        at = np.flatnonzero(inside[lo : lo + BLOCK])
        if not len(at):
            continue
        h = hasher(data[lo : lo + BLOCK + length - 1], name)
        anchor = (least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - name + 1)[at] & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
        yield lo + at[first], np.diff(np.r_[first, len(at)]), anchor[first] - at[first], h[anchor[first]]


def packed(lo, n, back) -> np.ndarray:
    return (lo << 16) | ((n - 1) << 8) | back


def unpacked(at):
    return at >> 16, ((at >> 8) & 255) + 1, at & 255


def _runs(batches: Iterator[pa.RecordBatch], length: int, name: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to RUN."""
    import xxhash

    hasher, content = Hasher(BLOCK + length), xxhash.xxh64_intdigest
    for b in batches:
        texts = [t or b"" for t in text_bytes(b.column(1))]
        ends = np.cumsum([len(t) for t in texts])
        starts, data = ends - [len(t) for t in texts], b"".join(texts)
        inside = np.zeros(max(0, len(data) - length + 1), bool)
        for s, e in zip(starts, ends):
            inside[s : max(s, e - length + 1)] = True
        for lo, n, back, h in runs_of(np.frombuffer(data, np.uint8), inside, hasher, length, name):
            of = np.searchsorted(starts, lo, "right") - 1
            while len(wrong := np.flatnonzero(ends[of] <= lo)):  # an empty text starts where its successor does
                of[wrong] += 1
            spans = np.fromiter((content(data[i:j]) for i, j in zip(lo.tolist(), (lo + n - 1 + length).tolist())), np.uint64, len(lo))
            cols = [b.column(0).take(pa.array(of)), pa.array(packed(lo - starts[of], n, back)), pa.array(h.view(np.int64)), pa.array(spans.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "at", "name", "content"])
    give_back()


def runs(docs: DataFrame, length: int = LENGTH, name: int = NAME) -> DataFrame:
    """(key, at, name, content) of every run of docs (key, text binary)."""
    return docs.select("key", "text").mapInArrow(lambda it: _runs(it, length, name), RUN)


@dataclass
class Levels:
    """Sorted arrays (name, n) in the shared folder, by rank: rank r holds 2^r batches. found: tables (name) of names in more than one place, also once the place is gone to a
    higher level."""

    spark: SparkSession
    levels: dict[int, str] = field(default_factory=dict)
    found: list[DataFrame] = field(default_factory=list)

    def table(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _write(self, names: DataFrame) -> str:
        path = scratch(self.spark, "suffix-level")
        names.sortWithinPartitions("name").write.parquet(path)
        return path

    def add(self, batch: DataFrame) -> None:
        """batch: (name, ...), a row for each suffix."""
        own = self._write(batch.groupBy("name").agg(F.count("*").alias("n"), F.lit(1).alias("sides")))
        repeated, free = [self.table(own).filter("n > 1")], next(r for r in count() if r not in self.levels)
        for r, level in self.levels.items():
            if r > free:  # those below merge with the batch, which finds common names too
                repeated.append(self.table(own).join(self.table(level).select("name"), "name", "left_semi"))
        self.found += [written(x.select("name"), "suffix-found") for x in repeated]
        for r in range(free):
            other = self.levels.pop(r)
            both = self.table(own).unionByName(self.table(other)).groupBy("name").agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("sides"))
            merged = self._write(both)
            self.found.append(written(self.table(merged).filter("sides > 1").select("name"), "suffix-found"))
            discard(self.spark, own)
            discard(self.spark, other)
            own = merged
        self.levels[free] = own

    def shared(self) -> DataFrame:
        """(name) of all names found in more than one place so far."""
        out = self.found[0]
        for x in self.found[1:]:
            out = out.unionByName(x)
        return out.distinct()


def picked(docs: DataFrame, keys: DataFrame, sent: int) -> DataFrame:
    """The documents with these keys (each once)."""
    return docs.join(F.broadcast(keys) if keys.limit(sent + 1).count() <= sent else keys, "key", "left_semi")


def _spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (text, runs) to (name, content, back, span)."""
    for b in batches:
        out = []
        for text, of in zip(text_bytes(b.column(0)), b.column(1).to_pylist()):
            for r in of:
                lo, n, back = unpacked(r["at"])
                out.append((r["name"], r["content"], back, text[lo : lo + n - 1 + length]))
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["name", "content", "back", "span"])
    give_back()


def _pieces(span: bytes, back: int, length: int) -> Iterator[tuple[int, int, int]]:
    """Block of distances, its first and last window, of a run's span."""
    last = len(span) - length
    i = 0
    while i <= last:
        k = (back - i) // STEP
        j = min(last, back - k * STEP)
        yield k, i, j
        i = j + 1


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (name, content, back, span) to (name, content, i, j, core, whole): blocks of windows i to j, the hash of what all windows of such a block have in common, and of the block's content."""
    import xxhash

    h = xxhash.xxh64_intdigest
    for b in batches:
        out = []
        for name, content, back, span in zip(*(c.to_pylist() for c in b.columns)):
            for k, i, j in _pieces(span, back, length):
                a = back - k * STEP  # of the windows that such a block can have the last one starts here
                out.append((name, content, i, j, h(span[a : a - STEP + 1 + length], k), h(span[i : j + length], a - i)))
        cols = list(zip(*out)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.uint64(), pa.uint64())
        cols = [pa.array(c, t) for c, t in zip(cols, kinds)]
        yield pa.RecordBatch.from_arrays([c.view(pa.int64()) if c.type == pa.uint64() else c for c in cols], names=["name", "content", "i", "j", "core", "whole"])
    give_back()


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (name, content, core, i, j, span) to (name, content, core, i, window): the hash of each window."""
    import xxhash

    h = xxhash.xxh64_intdigest
    for b in batches:
        name, content, core, i, j, span = (c.to_pylist() for c in b.columns)
        n = np.array([y - x + 1 for x, y in zip(i, j)], np.int64)
        rep = lambda c: np.repeat(np.array(c, np.int64), n)
        at = [w for x, y in zip(i, j) for w in range(x, y + 1)]
        hashes = np.array([h(s[w : w + length]) for s, x, y in zip(span, i, j) for w in range(x, y + 1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rep(name)), pa.array(rep(content)), pa.array(rep(core)), pa.array(at, pa.int32()), pa.array(hashes)], names=["name", "content", "core", "i", "window"])
    give_back()


def marks(docs: DataFrame, candidates: DataFrame, length: int = LENGTH, sent: int = SENT) -> DataFrame:
    """candidates: RUN under repeated names. (name, content, windows): which windows of a run of this content are repeated; null for all."""
    own = Tables(docs.sparkSession)
    contents = own.written(candidates.groupBy("name", "content").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one")), "suffix-contents")
    several = own.written(contents.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1").select("name"), "suffix-several")
    ones = contents.join(several, "name", "left_semi").select("name", "content", "one.key", "one.at")
    asked = own.written(ones.groupBy("key").agg(F.collect_list(F.struct("name", "content", "at")).alias("runs")), "suffix-asked")
    of = picked(docs, asked.select("key"), sent).dropDuplicates(["key"]).join(asked, "key").select("text", "runs")
    spans = own.written(of.mapInArrow(lambda it: _spans(it, length), "name bigint, content bigint, back int, span binary"), "suffix-spans")
    blocks = own.written(spans.mapInArrow(lambda it: _blocks(it, length), "name bigint, content bigint, i int, j int, core bigint, whole bigint"), "suffix-blocks")
    kinds = own.written(blocks.groupBy("core", "whole").agg(F.count("*").alias("n")), "suffix-kinds")
    alike = blocks.join(kinds.filter("n > 1"), ["core", "whole"], "left_semi").select("name", "content", F.explode(F.sequence("i", "j")).alias("i"))
    cores = own.written(kinds.groupBy("core").agg(F.count("*").alias("c")).filter("c > 1").select("core"), "suffix-cores")
    open_ = blocks.join(cores, "core", "left_semi").select("name", "content", "core", "i", "j")
    each = own.written(open_.join(spans, ["name", "content"]).select("name", "content", "core", "i", "j", "span").mapInArrow(lambda it: _windows(it, length), "name bigint, content bigint, core bigint, i int, window bigint"), "suffix-windows")
    met = each.join(each.groupBy("core", "window").agg(F.count("*").alias("n")).filter("n > 1"), ["core", "window"], "left_semi").select("name", "content", "i")
    some = alike.unionByName(met).groupBy("name", "content").agg(F.collect_set("i").alias("windows"))  # a run's windows: 137 at most
    out = contents.select("name", "content", "n").join(some, ["name", "content"], "left").filter("n > 1 OR windows IS NOT NULL").select("name", "content", F.when(F.col("n") == 1, F.col("windows")).alias("windows"))
    out = written(out, "suffix-marks")
    own.clear()
    return out


def _trimmed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, hits) to (doc_id, n_bytes, spans, kept)."""
    for b in batches:
        spans, kept, size = [], [], []
        for text, hits in zip(text_bytes(b.column(1)), b.column(2).to_pylist()):
            text, starts = text or b"", []
            for x in hits or []:
                lo, n, _ = unpacked(x["at"])
                starts.append(np.arange(lo, lo + n) if x["windows"] is None else lo + np.array(x["windows"], np.int64))
            s = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
            first = np.flatnonzero(np.r_[True, s[1:] > s[:-1] + length]) if len(s) else np.zeros(0, np.int64)
            a, e = s[first], (s[np.r_[first[1:], len(s)] - 1] + length if len(s) else s)
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), e.tolist())])
            kept.append(b"".join(text[x:y] for x, y in zip([0, *e.tolist()], [*a.tolist(), len(text)])))
            size.append(len(text))
        cols = [b.column(0), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "spans", "kept"])
    give_back()


def trimmed(docs: DataFrame, batches: int = 3, length: int = LENGTH, name: int = NAME, sent: int = SENT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): of every document the maximal repeated spans in bytes, and the bytes that stay."""
    if not 0 < name <= length or length - name > 255:
        raise ValueError("names are parts of windows, shorter by 255 bytes at most")
    spark = docs.sparkSession
    text_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), key_of().alias("key"))
    own, family = Tables(spark), Levels(spark)
    table = own.written(runs(keyed, length, name).withColumn("batch", F.pmod("key", F.lit(batches)).cast("int")), "suffix-runs", "batch")
    for k in range(batches):
        family.add(table.filter(F.col("batch") == k).select("name"))
    shared = own.written(family.shared(), "suffix-shared")
    candidates = written(table.drop("batch").join(shared, "name", "left_semi").select("key", "at", "name", "content"), "suffix-candidates")
    own.clear()
    marked = marks(keyed, candidates, length, sent)
    hits = candidates.join(marked, ["name", "content"]).groupBy("key").agg(F.collect_set(F.struct("at", "windows")).alias("hits"))  # a text's own: fewer than its bytes
    hits = written(hits, "suffix-hits")
    schema = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    if hits.limit(sent + 1).count() <= sent:
        keys = F.broadcast(hits.select("key"))
        with_hits = keyed.join(keys, "key", "left_semi").join(hits, "key").select("doc_id", "text", "hits")
        whole = keyed.join(keys, "key", "left_anti").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.coalesce("text", F.lit(b"")).alias("kept"))
        return with_hits.mapInArrow(lambda it: _trimmed(it, length), schema).unionByName(whole)
    return keyed.join(hits, "key", "left").select("doc_id", "text", "hits").mapInArrow(lambda it: _trimmed(it, length), schema)


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The digest of trimmed()."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return trimmed(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
