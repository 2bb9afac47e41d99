"""Operator 7: SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. Two fingerprints at most `radius` bits apart differ little in one segment at least, so each fingerprint is
entered in that segment's table under every key of a small Hamming ball around its segment, and entries that meet under a key are verified over all
64 bits. Balls are enumerated downwards only (a differing bit is set in exactly one of the two, so clearing bits on both sides meets at the common
bits): half the keys, same pairs.

Equal fingerprints are one node from the start, so groups of copies cost nothing here. Keys are worked off in numpy, some at a time, and a
task emits a spanning forest of the links it verified, never all pairs of a group: first under the segments as they are, then, between different
components only, under the balls. A key under which more than `block` fingerprints meet is split into blocks that meet pair by pair in different
tasks. Links are joined by `components` over written tables; nothing but counts reaches the driver. Joins on a component or a fingerprint are between
plain exchanges whatever Spark's broadcast threshold, so no side passes through the driver and adaptive execution splits the rows of a large one.

Segments follow the number of distinct fingerprints n: about 64 / log2(n) of them, at least two, so that a table has about as many keys as entries.

Edge cases: a null text is empty; a text without words has fingerprint zero and is linked like any other; null doc_ids are kept and get the component
of their fingerprint; repeated rows are separate rows; texts of any length are read whole, bytes that aren't UTF-8 as they are; a bit set in exactly half
the shingles is zero; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, give_back, parallelism, text_batches, whole_groups, written
from .components import connected
from .encoding import slices

SEED = 42


def shingles(text: bytes | None, size: int) -> list[bytes]:
    """Space-joined runs of `size` words, A-Z lower-cased; the whole sequence if there are fewer; none without words."""
    words = text.lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    if len(words) <= size:
        return [joined]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())]


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of the shingles, repeats included."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.array([h(s, SEED) for s in shingles(text, size)], np.uint64)


def folded(hashes: np.ndarray) -> int:
    """64 bits; a bit is one if set in over half the hashes."""
    if not len(hashes):
        return 0
    ones, hashes = np.zeros(64, np.int64), hashes.astype(">u8")
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None, size: int) -> int:
    return folded(shingle_hashes(text, size))


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1)
        f = np.array([fingerprint(t.as_py(), size) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    text_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(lambda it: _fingerprints(it, size), "doc_id bigint, fp bigint")


def plan(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(low bit, width, ball radius) of each segment for n fingerprints; the balls' radii r fulfil sum(r + 1) = radius + 1, so no pair is missed."""
    m = max(2, min(radius + 1, round(64 / max(1.0, math.log2(max(2, n))))))
    cuts = [round(64 * i / m) for i in range(m + 1)]
    r = [(radius + 1) // m - 1 + (i < (radius + 1) % m) for i in range(m)]
    return [(a, b - a, k) for a, b, k in zip(cuts[:-1], cuts[1:], r)]


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(1, radius + 1) for c in combinations(range(width), k)]


def _entries(batches: Iterator[pa.RecordBatch], segments: list, balls: bool) -> Iterator[pa.RecordBatch]:
    """(table, key, fp, comp): each segment as it is, or with its ball below (cleared bits)."""
    masks = [_masks(w, r) if balls else [] for _, w, r in segments]
    names = ["seg", "key", "fp", "comp"]
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            s = b.slice(lo, 2000)
            fp, comp = s.column(0).to_numpy().view(np.uint64), s.column(1).to_numpy()
            for t, (low, width, _) in enumerate(segments):
                key = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
                keys, rows = [key], [np.arange(len(fp))]
                for m in masks[t]:
                    at = np.flatnonzero((key & np.uint64(m)) == np.uint64(m))
                    keys.append(key[at] ^ np.uint64(m))
                    rows.append(at)
                r = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), t, np.int32)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(fp[r].view(np.int64)), pa.array(comp[r])], names=names)


def _find(parent: list, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """From rows (seg, key, i, j, side, fp, comp) sorted by the first four: verified links between different components, as a
    forest over comp for each batch of keys."""
    for cols in whole_groups(batches, 4):
        yield _forest(cols, radius)
    give_back()


def _forest(cols: list[np.ndarray], radius: int) -> pa.RecordBatch:
    side, fp, comp = cols[4], cols[5].view(np.uint64), cols[6]
    change = np.zeros(len(fp), bool)
    for c in cols[:4]:
        change[1:] |= c[1:] != c[:-1]
    group = np.cumsum(change)
    nodes, node = np.unique(comp, return_inverse=True)
    parent, label = list(range(len(nodes))), np.arange(len(nodes))
    us, vs = [], []
    at, lag = np.arange(len(fp)), 1
    diagonal = cols[2] == cols[3]
    while True:
        at = at[at + lag < len(fp)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        a, b = at, at + lag
        m = (label[node[a]] != label[node[b]]) & (diagonal[a] | (side[a] != side[b]))
        a, b = a[m], b[m]
        m = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        a, b = a[m], b[m]
        if len(a):
            moved = False
            for x, y in set(zip(label[node[a]].tolist(), label[node[b]].tolist())):
                x, y = _find(parent, x), _find(parent, y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    us.append(nodes[x])
                    vs.append(nodes[y])
                    moved = True
            if moved:
                p = np.array(parent)
                while not np.array_equal(p, p[p]):
                    p = p[p]
                parent, label = p.tolist(), p
        lag += 1
    pairs = sorted(set(zip(us, vs)))
    return pa.RecordBatch.from_arrays([pa.array([int(p[0]) for p in pairs], pa.int64()), pa.array([int(p[1]) for p in pairs], pa.int64())], names=["u", "v"])


def links(nodes: DataFrame, segments: list, n: int, radius: int, balls: bool, block: int) -> DataFrame:
    """n nodes (fp, comp) -> links (u, v) between components that hold fingerprints at most radius bits apart under a common key."""
    e = nodes.select("fp", "comp").mapInArrow(lambda it: _entries(it, segments, balls), "seg int, key bigint, fp bigint, comp bigint")
    hot = e.groupBy("seg", "key").agg(F.count("*").alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b")).filter("n > 1 AND a <> b")
    hot = hot.select("seg", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    e = e.join(dealt(hot), ["seg", "key"])
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    e = e.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    e = e.select("seg", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).cast("int").alias("side"), "fp", "comp")
    entries = n * sum(1 + balls * len(_masks(w, r)) for _, w, r in segments)
    e = e.repartition(parallelism(nodes.sparkSession, entries), "seg", "key", "i", "j").sortWithinPartitions("seg", "key", "i", "j", "fp")
    return e.mapInArrow(lambda it: _links(it, radius), "u bigint, v bigint")


def linked(distinct: DataFrame, n: int, radius: int = 4, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """From n rows (fp): (nodes, links). nodes: (fp, comp), comp a fingerprint reachable over links under unchanged segments; links (u, v) between those: what
    is reachable over links of at most radius bits is what nodes and links connect."""
    segments = plan(n, radius)
    nodes = distinct.select("fp", F.col("fp").alias("comp"))
    own = written(links(nodes, segments, n, radius, False, block), "simhash-links")
    first = connected(own, settle=False)
    nodes = written(merged(nodes, first), "simhash-own")
    more = written(links(nodes, segments, n, radius, True, block), "simhash-links")  # not read by the next Python stage in the same task
    return nodes, own.unionByName(more).unionByName(first.select(F.col("node").alias("u"), F.col("label").alias("v")))


def components(fps: DataFrame, radius: int = 4, block: int = 4096) -> DataFrame:
    """From (doc_id, fp): (fp, comp, component_id, first_doc, n_docs): every distinct fingerprint with its component's least fingerprint and the smallest
    doc_id reachable over links of at most radius bits."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs")), "simhash-nodes")
    nodes, found = linked(distinct, distinct.count(), radius, block)
    both = written(distinct.join(dealt(merged(nodes, connected(found))), "fp"), "simhash-components")
    least = written(both.groupBy("comp").agg(F.min("first_doc").alias("component_id")), "simhash-least")
    return both.join(dealt(least), "comp").select("fp", "comp", "component_id", "first_doc", "n_docs")


def merged(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with comp replaced by its label, where it has one."""
    return nodes.join(dealt(labels.select(F.col("node").alias("comp"), "label")), "comp", "left").select("fp", F.coalesce("label", "comp").alias("comp"))


def op7(spark: SparkSession, docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (null only where a component has null doc_ids alone)."""
    fps = written(fingerprints(docs, size), "simhash")
    return fps.join(dealt(components(fps, radius)), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
