"""Operator 2: mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2, ... are mapped by golden-ratio points through the sources' cumulative weights; a slot's rank among its source's slots names an epoch and,
through a shuffle of the source's blocks, a block of `block_words` consecutive words of the source (documents in ascending doc_id order). The first
words of a source's last slot complete its budget exactly. Ranks need no pass over earlier slots: how many of the first n points fall into an interval
is a sum of floors, so every chunk of slots is computed by itself.

Points are (a*i mod m) / m with m = 2^31 - 1 and a/m next to the golden ratio's fraction: exact in integers, for any number of slots. Where a source
gets a slot or two less than its budget needs, slots are appended; where it gets more, the ranks beyond are not used.

The sources' totals are on the driver: a row for each source (at most `max_sources`) and partition.

Edge cases: a null text has no words; a null source is a source of its own, last in order; documents without words and null doc_ids are kept with taken
0 or their own share; rows that repeat a doc_id count one by one; a very long text is many blocks' words, taken by blocks; ties in source and doc_id go by
size and text hash; an empty table gives no rows; other columns, whatever their names, are ignored by mix() and kept by mixed_documents(), whose rows come in
no order: the manifest has the slots, and a reader that sorts by doc_id (as token files do) keeps the mix's amounts, not its order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, free, ranged, running_sums, small_table, text_batches, text_bytes, word_count

#: The schedule's points: multiplier and modulus.
MODULUS = 2**31 - 1
MULTIPLIER = 1327217884
WEIGHTS = (5, 2, 1)
CHUNK = 1 << 18


def targets(sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, most: float = 3.0) -> list[float]:
    """Sources' words in the mix: all words shared by weight, none above `most` times its size, the excess shared again by weight."""
    total = float(sum(n for _, n in sizes))
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        w = sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if rest * weights[i % len(weights)] / w > most * sizes[i][1]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i % len(weights)] / w
            break
        for i in over:
            out[i] = most * sizes[i][1]
        rest -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """Sum of floor((a*i + b) / m) for i < n."""
    total = 0
    while True:
        if a >= m:
            total += n * (n - 1) // 2 * (a // m)
            a %= m
        if b >= m:
            total += n * (b // m)
            b %= m
        top = a * n + b
        if top < m:
            return total
        n, b = divmod(top, m)
        m, a = a, m


def points_below(n: int, cut: int) -> int:
    """How many of the first n points lie below cut / MODULUS."""
    return floor_sum(n, MODULUS, MULTIPLIER, 0) - floor_sum(n, MODULUS, MULTIPLIER, MODULUS - cut) + n


def shuffled(position: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1 by a keyed Feistel network, walked until it lands inside."""
    bits = max(2, (max(n - 1, 1)).bit_length())
    half = (bits + 1) // 2
    mask = np.uint64((1 << half) - 1)

    def once(x):
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            k = np.uint64((seed * 0x9E3779B1 + r * 0x85EBCA77 + 1) & 0xFFFFFFFF)
            h = ((b + k) * np.uint64(0x2545F491)) & np.uint64(0xFFFFFFFF)
            h = ((h ^ (h >> np.uint64(15))) * np.uint64(0x27D4EB2F)) & np.uint64(0xFFFFFFFF)
            a, b = b, (a ^ (h ^ (h >> np.uint64(13)))) & mask
        return (a << np.uint64(half)) | b

    x = once(position.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


class Source:
    """A source's blocks and budget."""

    def __init__(self, index: int, size: int, target: float, block: int):
        self.index, self.size, self.block = index, size, block
        self.budget = min(int(round(target)), 3 * size)
        self.full, self.tail = divmod(size, block)
        self.blocks = self.full + (self.tail > 0)
        epochs, rest = divmod(self.budget, size) if size else (0, 0)
        self.slots = epochs * self.blocks + -(-rest // block)

    def place(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Epoch, block and words taken from its start of each rank; the short last block keeps its place, so words before a rank are known."""
        epoch, position = rank // self.blocks, rank % self.blocks
        block = position.copy()
        inner = position < self.full
        if inner.any():
            block[inner] = shuffled(position[inner], self.full, self.index + 1)
        length = np.where(block < self.full, self.block, self.tail)
        left = self.budget - (epoch * self.size + position * self.block)
        return epoch, block, np.minimum(length, left)


def _slots(batches: Iterator[pa.RecordBatch], sources: list[Source], cuts: list[int], total: int) -> Iterator[pa.RecordBatch]:
    edges = np.array(cuts[1:], np.int64)
    for b in batches:
        for chunk in b.column(0).to_pylist():
            lo, hi = chunk * CHUNK, min(total, (chunk + 1) * CHUNK)
            i = np.arange(lo, hi, dtype=np.int64)
            x = (i % MODULUS) * MULTIPLIER % MODULUS
            owner = np.searchsorted(edges, x, side="right")
            yield from _ranked(i, owner, sources, lambda s: points_below(lo, cuts[s + 1]) - points_below(lo, cuts[s]))


def _ranked(slot: np.ndarray, owner: np.ndarray, sources: list[Source], before) -> Iterator[pa.RecordBatch]:
    order = np.argsort(owner, kind="stable")
    found, first = np.unique(owner[order], return_index=True)
    for s, at, n in zip(found.tolist(), first, np.diff(np.r_[first, len(owner)])):
        src, rank = sources[s], before(s) + np.arange(n, dtype=np.int64)
        rows = order[at : at + n][rank < src.slots]
        rank = rank[rank < src.slots]
        if len(rank):
            epoch, block, words = src.place(rank)
            yield pa.RecordBatch.from_arrays([pa.array(slot[rows]), pa.array(np.full(len(rank), src.index, np.int32)), pa.array(rank), pa.array(epoch), pa.array(block), pa.array(words)], names=["slot", "source_no", "rank", "epoch", "block", "words"])


SLOT_SCHEMA = "slot bigint, source_no int, rank bigint, epoch bigint, block bigint, words bigint"


def schedule(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(slot, source_no, rank, epoch, block, words): the mix in order, block by block."""
    total = sum(s.slots for s in sources)
    sums = reduce(lambda acc, s: [*acc, acc[-1] + s.slots], sources, [0])
    cuts = [MODULUS * x // max(total, 1) for x in sums]
    chunks = -(-total // CHUNK)
    main = spark.range(0, chunks, 1, max(1, min(chunks, 4096))).mapInArrow(lambda it: _slots(it, sources, cuts, total), SLOT_SCHEMA)
    more, at = [], total
    for k, s in enumerate(sources):
        got = points_below(total, cuts[k + 1]) - points_below(total, cuts[k])
        if got < s.slots:
            rank = np.arange(got, s.slots, dtype=np.int64)
            epoch, block, words = s.place(rank)
            more += [(at + i, s.index, *map(int, row)) for i, row in enumerate(zip(rank, epoch, block, words))]
            at += len(rank)
    return main.unionByName(small_table(spark, more, SLOT_SCHEMA)) if more else main


def mix(docs: DataFrame, block_words: int = 1024, weights: tuple = WEIGHTS, max_sources: int = 100_000, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, manifest). documents: doc_id, source, size, source_no, source_size, target, start (words of its source before it), one row for each
    row of docs. manifest: slot, epoch, source_no, start, doc_id, from_word, to_word: the words that each slot takes of each document."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), (_key() if key is None else key).alias("key"))
    table, sums = running_sums(ranged(narrow, F.asc_nulls_last("source"), F.asc_nulls_first("doc_id"), F.asc("size"), F.asc("key")), "size", "source", "mix")
    names = sorted({s for _, s in sums if s is not None}) + [None] * any(s is None for _, s in sums)
    if len(names) > max_sources:
        raise ValueError(f"{len(names)} sources; raise max_sources if the driver can hold a row for each")
    sizes = [0] * len(names)
    number = {s: i for i, s in enumerate(names)}
    base = []
    for (part, s), (words, _) in sorted(sums.items(), key=lambda x: x[0][0]):
        k = number[s]
        base.append([part, s, k, sizes[k]])
        sizes[k] += words
    goal = targets(list(zip(names, sizes)), weights)
    base = small_table(spark, [(*x, sizes[x[2]], float(goal[x[2]])) for x in base], "_p int, _s string, source_no int, _base bigint, source_size bigint, target double")
    documents = table.join(F.broadcast(base), (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    documents = documents.select("key", "doc_id", "source", "size", "source_no", "source_size", "target", (F.col("_base") + F.col("_before")).alias("start"))
    pieces = documents.filter("size > 0").select("doc_id", "source_no", "start", "size", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
    slots = schedule(spark, [Source(i, n, g, block_words) for i, (n, g) in enumerate(zip(sizes, goal))])
    begin = F.col("block") * block_words
    manifest = pieces.join(slots, ["source_no", "block"]).select(
        "slot", "epoch", "source_no", "start", "doc_id",
        (F.greatest(F.col("start"), begin) - F.col("start")).alias("from_word"),
        (F.least(F.col("start") + F.col("size"), begin + F.col("words")) - F.col("start")).alias("to_word"),
    )
    return documents, manifest.filter("from_word < to_word")


def _key() -> Column:
    """What makes rows one document: doc_id, source and text, null apart from any value."""
    each = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0")) for c in ("doc_id", "source")]
    return F.concat_ws("/", *each, F.hex(F.xxhash64(F.col("text").cast("string"))))


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each document's share of the mix."""
    documents, manifest = mix(docs)
    taken = manifest.groupBy("source_no", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    taken = taken.select(F.col("source_no").alias("_n"), F.col("start").alias("_s"), "taken")
    out = documents.join(taken, (F.col("source_no") == F.col("_n")) & (F.col("start") == F.col("_s")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text from the first to the last word of each span of words, as it stands; a line end between distant spans."""
    words = [m.span() for m in re.finditer(WORD.encode(), text)]
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    return b"\n".join(text[words[a][0] : words[b - 1][1]] for a, b in joined)


def _cut(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Rows with spans (word ranges) and words next to last and last: the text cut to the spans, whole texts as they are."""
    for b in batches:
        texts = []
        for text, spans, size in zip(text_bytes(b.column(at)), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            if text is None or not spans or sum(s["to_word"] - s["from_word"] for s in spans) == size:
                texts.append(text)
            else:
                texts.append(cut(text, [(s["from_word"], s["to_word"]) for s in spans]))
        cols = [*b.columns[:-2]]
        cols[at] = pa.array(texts, pa.binary()).view(pa.string())
        yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-2])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row of docs for each epoch that takes words of it, every column as it was, the text cut to the words taken where it isn't
    taken whole. A document without words stays once. Rows alike in every column are one document here; it is taken as often as all of them."""
    text_batches(docs.sparkSession)
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in ("doc_id", "source", "text") and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    own = F.concat_ws("/", _key(), F.hex(F.xxhash64(*rest, *[c.isNull() for c in rest]))) if rest else _key()
    documents, manifest = mix(docs, key=own, **options)
    spans = manifest.groupBy("source_no", "start", "epoch").agg(F.collect_list(F.struct("from_word", "to_word")).alias("_spans"))
    spans = spans.select(F.col("source_no").alias("_n"), F.col("start").alias("_s"), "epoch", "_spans")
    taken = documents.join(spans, (F.col("source_no") == F.col("_n")) & (F.col("start") == F.col("_s")) & (F.col("size") > 0), "left")
    some = taken.filter("size > 0 AND epoch IS NOT NULL").select("key", "_spans", "size")
    none = taken.filter("size = 0").select("key", F.lit(None).cast("array<struct<from_word:bigint,to_word:bigint>>").alias("_spans"), "size").dropDuplicates(["key"])
    names = docs.columns
    key, at, n = free(docs, "_key", "_spans", "_size")
    taken = some.unionByName(none).select(F.col("key").alias(key), F.col("_spans").alias(at), F.col("size").alias(n))
    one = docs.withColumn(key, own).dropDuplicates([key])
    out = one.join(taken, key).select(*[F.col(f"`{x}`") for x in names], at, n)
    return out.mapInArrow(lambda it: _cut(it, names.index("text")), docs.schema)
