"""Near-dedup of documents, as a stage: one document of each group stays.

Shingles have five words; two documents are duplicates at a similarity (Jaccard) of 0.8 or more, and a group is what duplicates connect. Every link is
compared by shingles; two ways lead to candidates:

1. SimHash with multi-index hashing (`simhash`): texts whose fingerprints a chain of links of at most `close` bits connects are compared with the least one
   of them. That collapses most groups of near copies without their pairs.
2. What fingerprints can't say (a pair at 0.8 differs by some ten bits, many by more) is found by prefix filtering, which misses no pair: texts of equal
   words are one node; a node's distinct shingles stand in one order that all share (the frequent ones of a sample last, so the order decides the cost,
   never the result), and two nodes at 0.8 have a common shingle among the first fifth of both. Nodes are entered under these; those that meet, and could
   reach 0.8 by their sizes and the shingle's places, are candidates.

Keys of up to `limit` entries make few pairs whatever a group's size, at most (limit - 1) / 2 for an entry. Under keys with more two nodes, the one with the fewest rarer shingles and another, chosen anew in every turn, are compared with those of other classes first (stars), so what SimHash left of a large
group collapses as well: while such keys hold several classes and turns find links, up to `rounds` times. Then all pairs under every key whose nodes aren't
in one class yet are compared, in blocks: every member is entered, so none is skipped for another. Classes are settled before each turn, or one group would count as many. Stars and blocks emit only pairs of different classes, and of these
only what a sketch of both sets leaves possible: for each of 2,048 buckets of hashes, whether the set has an odd number in it. Every bucket in which two sketches differ
holds a shingle that one set alone has, so the number of such buckets is a lower bound of the sets' difference, which 0.8 and the sizes bound from above. The bound loses
no pair, and up to some thousand words it is tight: of texts at a similarity of 0.75 hardly a pair is left to compare by shingles.

Texts of candidates are picked by their nodes: up to `sent` nodes (8 bytes each) are sent to the texts, so these don't move; more nodes than that are joined with
the texts, which moves them. Both give the same rows; the second alone would move all texts once in every turn, the first alone would have no bound.

Edge cases: a null text is an empty one; texts without words are all alike; a document without an id stays only in groups that have
no other; of rows that repeat a doc_id in a group one stays; texts of any length are compared whole, bytes that aren't UTF-8 as they are; ties go to the least
doc_id; an empty table stays empty. Every column is kept, whatever its name. Hashes have 64 bits for words and entries, 32 for comparing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, give_back, parallelism, text_batches, text_bytes, text_parts, whole_groups, written
from .components import connected
from .simhash import SEED, folded, linked, merged, shingle_hashes, shingles

SIZE = 5
#: Ids (8 bytes each) up to which the side that selects texts is broadcast.
SENT = 1_000_000
#: Nodes sampled for the order of shingles, and the most shingles (16 bytes each) that are put last by it.
SAMPLE, FREQUENT = 20_000, 100_000
ENTRY = "key bigint, node bigint, size int, pos int"
#: An entry with its class, without the key and its node's sketch.
FIELDS = ("node", "size", "pos", "class")
#: Buckets of a sketch, a power of two.
BUCKETS = 2048


def sketch(hashes: np.ndarray) -> bytes:
    """Whether the number of distinct hashes in each bucket is odd, a bit for each."""
    at = np.unique(hashes) >> np.uint64(64 - (BUCKETS.bit_length() - 1))
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BUCKETS).astype(np.uint8) & 1).tobytes()


def _sketches(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, BUCKETS // 64)


def _marked(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds the hash of the words, the fingerprint and the sketch."""
    import xxhash

    for b in batches:
        texts = [t or b"" for t in text_bytes(b.column(at))]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split()), SEED) for t in texts], np.uint64).view(np.int64)
        f, s = np.zeros(len(texts), np.uint64), []
        for i, t in enumerate(texts):
            own = shingle_hashes(t, SIZE)
            f[i] = folded(own)
            s.append(sketch(own))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h), pa.array(f.view(np.int64)), pa.array(s, pa.binary())], names=[*b.schema.names, *names])
    give_back()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(s, SEED) for s in shingles(text, SIZE)], "<u8"))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.column(1):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py()).view(np.int64))], names=["key"])
    give_back()


def frequent(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the sampled nodes have, ascending, and their places from rare to frequent."""
    sample = texts.filter(F.pmod("node", F.lit(max(1, n // SAMPLE))) == 0).mapInArrow(_sampled, "key bigint")
    top = sample.groupBy("key").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    keys = np.array([r.key for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(top) - np.arange(len(top)))[order]


def prefix(h: np.ndarray, last: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set (ascending) in the common order: so many that sets which reach `least` share one of them."""
    keys, place = last
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        rank = np.where(keys[at] == h, place[at], 0)
        h = h[np.argsort(rank, kind="stable")]
    return h[: len(h) - math.ceil(least * len(h) - 1e-9) + 1]


def _entered(batches: Iterator[pa.RecordBatch], last, least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            s = b.slice(lo, 500)
            nodes, found = s.column(0).to_numpy(), [shingle_set(t.as_py()) for t in s.column(1)]
            keys = [prefix(h, last.value, least) if len(h) else h for h in found]
            n = [len(k) for k in keys]
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
            cols = [np.concatenate(keys).astype(np.uint64).view(np.int64), np.repeat(nodes, n), np.repeat(np.array([len(h) for h in found], np.int32), n), pos]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "size", "pos"])
    give_back()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by key, those whose key has another one. A batch's last entry waits for the next batch if its key is new."""
    last, wait = None, None  # the last key, and its entry if it is the only one so far
    for b in batches:
        if not b.num_rows:
            continue
        if wait is not None:
            b = pa.Table.from_batches([wait, b]).combine_chunks().to_batches()[0]
        key = b.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        if wait is None and last is not None:
            keep |= key == last
        last, wait = key[-1], None if keep[-1] else b.slice(len(key) - 1)
        yield b.filter(pa.array(keep))
    give_back()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, sorted distinct 32-bit hashes of the shingles, their numbers in 256 buckets (255 at most)."""
    for b in batches:
        found = [np.unique(shingle_set(t.as_py()).astype("<u4")) for t in b.column(1)]
        counts = [np.minimum(np.bincount(h >> np.uint32(24), minlength=256), 255).astype(np.uint8).tobytes() for h in found]
        cols = [b.column(0), pa.array([h.tobytes() for h in found], pa.binary()), pa.array(counts, pa.binary()), pa.array([len(h) for h in found], pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["node", "shingles", "counts", "size"])
    give_back()


def _possible(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """u, v of pairs (u, v, counts and size of both) whose sets can reach the similarity: buckets differ by no more than sets do."""
    for b in batches:
        c, d = (np.frombuffer(b"".join(x.as_py() for x in b.column(k)), np.uint8).reshape(-1, 256).astype(np.int16) for k in (2, 4))
        size = b.column(3).to_numpy().astype(np.int64) + b.column(5).to_numpy()
        m = pa.array(np.abs(c - d).sum(1, dtype=np.int64) <= size * (1 - least) / (1 + least) + 1e-6)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m)], names=["u", "v"])


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """u, v of pairs whose sets (columns 2, 3) reach the similarity."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):
            p, q = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
            n = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(n >= least * (len(p) + len(q) - n) - 1e-9)
        m = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m)], names=["u", "v"])


def _in_pairs(rows: DataFrame, pairs: DataFrame, sent: int) -> DataFrame:
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return rows.join(F.broadcast(nodes) if 2 * pairs.count() <= sent or nodes.count() <= sent else nodes, "node", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, least: float, sent: int) -> DataFrame:
    """The pairs (u, v) whose shingle sets reach the similarity; only texts of nodes in a pair are read into sets, and sets move for pairs only whose buckets
    leave it open."""
    sets = written(_in_pairs(texts, pairs, sent).mapInArrow(_sets, "node bigint, shingles binary, counts binary, size int"), "dedup-sets")
    x, y = (sets.select(F.col("node").alias(k), "counts", "size").toDF(k, f"c{k}", f"s{k}") for k in "uv")
    both = pairs.join(x, "u").join(y, "v").select("u", "v", "cu", "su", "cv", "sv")
    pairs = written(both.mapInArrow(lambda it: _possible(it, least), "u bigint, v bigint"), "dedup-possible")
    sets = _in_pairs(sets.select("node", "shingles"), pairs, sent)
    both = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v").select("u", "v", "x", "y")
    return both.mapInArrow(lambda it: _alike(it, least), "u bigint, v bigint")


def _can(size: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether rows a and b can reach the similarity if their key is their first common one (a pair that does meets under that key too)."""
    need = np.ceil(least / (1 + least) * (size[a].astype(np.int64) + size[b]) - 1e-9)
    return np.minimum(size[a] - pos[a], size[b] - pos[b]) >= need


def _groups(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by cols: each row's group, the groups' first rows and their sizes."""
    change = np.zeros(len(cols[0]), bool)
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(np.r_[True, change[1:]])
    return np.cumsum(change), first, np.diff(np.r_[first, len(change)])


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.minimum(*p) for p in found], [np.maximum(*p) for p in found]))
    pairs = np.unique(np.c_[u, v], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _near(sketches: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of rows a and b can reach the similarity: no more buckets differ than the sets' difference has shingles."""
    out, step = np.zeros(len(a), bool), 1 << 14
    for lo in range(0, len(a), step):
        x, y = a[lo : lo + step], b[lo : lo + step]
        apart = np.bitwise_count(sketches[x] ^ sketches[y]).sum(1, dtype=np.int64)
        out[lo : lo + step] = apart <= (size[x].astype(np.int64) + size[y]) * (1 - least) / (1 + least) + 1e-6
    return out


def _block_pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, node, size, pos, class, sketch) sorted by the first three: pairs of a block (i = j), or across two, of different
    classes, that sizes, places and sketches leave open."""
    for key, i, j, side, node, size, pos, comp, sketches in whole_groups(batches, 3):
        sketches = _sketches(sketches)
        group, _, _ = _groups([key, i, j])
        within, found, at, lag = i == j, [], np.arange(len(key)), 1
        while True:
            at = at[at + lag < len(key)]
            at = at[group[at] == group[at + lag]]
            if not len(at):
                break
            m = at[(comp[at] != comp[at + lag]) & (within[at] | (side[at] != side[at + lag]))]
            m = m[_can(size, pos, m, m + lag, least)]
            m = m[_near(sketches, size, m, m + lag, least)]
            found.append((node[m], node[m + lag]))
            lag += 1
        yield _pairs(found)
    give_back()


def _mixed_keys(rows: DataFrame) -> DataFrame:
    """(key, n) of the keys whose nodes aren't in one class. All sums are partial, so a key's rows never meet."""
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("a"), F.max("class").alias("b"))
    return written(keys.filter("a <> b").select("key", "n"), "dedup-keys")


def _picked(rows: DataFrame, turn: int) -> DataFrame:
    """Of each key two nodes, also by partial sums: the one with the fewest rarer shingles before the key, and one by a hash of this turn. Of copies with few or
    many edits the first has the fewest, so it is near most of them; ties go by the hash, which differs from key to key and from turn to turn."""
    chance = F.pmod(F.xxhash64("key", "node", F.lit(turn)), F.lit(1 << 31))
    picked = [F.col("pos").cast("long") * (1 << 31) + chance, chance]
    return rows.groupBy("key").agg(*[F.min_by(c, h).alias(f"{c}_{k}") for k, h in enumerate(picked) for c in FIELDS])


def _star_pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows of an entry and the two picked ones of its key, five columns each (FIELDS and the sketch): pairs of different classes that sizes, places and sketches leave open."""
    for b in batches:
        cols, n, found = [c.to_numpy(zero_copy_only=False) for c in b.columns], b.num_rows, []
        for k in (5, 10):
            node, size, pos, comp, sketches = (np.r_[cols[i], cols[k + i]] for i in range(5))
            sketches = _sketches(sketches)
            m = np.flatnonzero(comp[:n] != comp[n:])
            m = m[_can(size, pos, m, m + n, least)]
            m = m[_near(sketches, size, m, m + n, least)]
            found.append((node[m], node[m + n]))
        yield _pairs(found)
    give_back()


def _stars(rows: DataFrame, keys: DataFrame, sketches: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs of the picked nodes of each key with its nodes of other classes."""
    rows = written(rows.join(keys.select("key"), "key"), "dedup-crowded")
    picked = _picked(rows, turn)
    for k in (0, 1):
        picked = picked.join(sketches.toDF(f"node_{k}", f"sketch_{k}"), f"node_{k}")
    both = rows.join(sketches, "node").join(written(picked, "dedup-picked"), "key")
    both = both.select(*FIELDS, "sketch", *[f"{c}_{k}" for k in (0, 1) for c in (*FIELDS, "sketch")])
    return both.mapInArrow(lambda it: _star_pairs(it, least), "u bigint, v bigint")


def _meet_all(rows: DataFrame, keys: DataFrame, sketches: DataFrame, least: float, block: int) -> DataFrame:
    """sketches: (node, sketch). All pairs of different classes under each key; a key's entries are split into blocks that meet pair by pair in different tasks."""
    keys = keys.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    n = keys.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    e = rows.join(keys.drop("n"), "key").join(sketches, "node")
    e = e.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    e = e.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).cast("int").alias("side"), *FIELDS, "sketch")
    e = e.repartition(parallelism(rows.sparkSession, n), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return e.mapInArrow(lambda it: _block_pairs(it, least), "u bigint, v bigint")


def _close(fps: DataFrame, n: int, close: int) -> DataFrame:
    """fps: (node, fp), n rows. Pairs of each node with the least one of those that links of at most `close` bits reach at first sight."""
    distinct = written(fps.groupBy("fp").agg(F.min("node").alias("first")), "dedup-fps")
    nodes, found = linked(distinct, n, close)
    comps = written(merged(nodes, connected(found, settle=False)), "dedup-close")
    both = written(fps.join(comps, "fp").select("node", "comp"), "dedup-close")
    least = written(both.groupBy("comp").agg(F.min("node").alias("u")), "dedup-least")
    return both.join(least, "comp").filter("u <> node").select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v"))


def classes(texts: DataFrame, n: int, fps: DataFrame, least: float = 0.8, rounds: int = 3, limit: int = 8, block: int = 4096, close: int = 4, sent: int = SENT) -> DataFrame:
    """texts: (node, text binary, sketch), n rows, each node once; fps: (node, fp). -> (node, label): every node that is joined to a lesser one, with its
    group's least node."""
    spark, sketches, texts = texts.sparkSession, texts.select("node", "sketch"), texts.select("node", "text")
    compared = written(_close(fps, n, close).distinct(), "dedup-pairs")
    links = written(_verified(compared, texts, least, sent), "dedup-links")
    last = spark.sparkContext.broadcast(frequent(texts, n))
    entries = texts.mapInArrow(lambda it: _entered(it, last, least), ENTRY).repartition(text_parts(texts), "key").sortWithinPartitions("key")
    met = written(entries.mapInArrow(_shared, ENTRY), "dedup-met")
    turn, found = 0, True
    while True:
        labels = connected(links)
        rows = met.join(labels, "node", "left").select("key", "node", "size", "pos", F.coalesce("label", "node").alias("class"))
        keys = _mixed_keys(rows)
        crowded = keys.filter(F.col("n") > limit)
        final = turn == rounds or not found or not crowded.head(1)
        pairs = (_meet_all(rows, keys, sketches, least, block) if final else _stars(rows, crowded, sketches, turn, least)).distinct()
        fresh = written(pairs.join(compared, ["u", "v"], "left_anti"), "dedup-pairs")
        new = written(_verified(fresh, texts, least, sent), "dedup-links")
        links, compared = links.unionByName(new), compared.unionByName(fresh)
        if final:
            return connected(links)
        turn, found = turn + 1, bool(new.head(1))


def unique(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, every column as it was: the one with the least doc_id. Options are those of classes()."""
    text_batches(docs.sparkSession)
    at, names, sent = docs.columns.index("text"), docs.columns, options.get("sent", SENT)
    node, fp, row, mark = free(docs, "_node", "_fp", "_row", "_sketch")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = docs.mapInArrow(lambda it: _marked(it, at, [node, fp, mark]), f"{fields}, {node} bigint, {fp} bigint, {mark} binary").withColumn(row, F.monotonically_increasing_id())
    marked = written(marked, "dedup-marked")
    rows = marked.select(F.col("doc_id").cast("long").alias("d"), F.col(node).alias("node"), F.col(row).alias("row"), F.col(fp).alias("fp"))
    each = written(rows.groupBy("node").agg(F.min(F.struct(F.col("d").isNull().alias("z"), "d", "row")).alias("m"), F.min("row").alias("row"), F.min("fp").alias("fp"), F.count("*").alias("copies")), "dedup-nodes")
    spare = rows.select("node", F.col("row").alias("r")).join(each.filter("copies > 1").select("node", F.col("row").alias("one")), "node").filter("r <> one").select(F.col("r").alias("row"))
    spare = written(spare, "dedup-copies")
    texts = marked.select(F.col(node).alias("node"), F.col("text").cast("binary").alias("text"), F.col(mark).alias("sketch"), F.col(row).alias("row"))
    texts = texts.join(F.broadcast(spare) if spare.count() <= sent else spare, "row", "left_anti").select("node", "text", "sketch")
    labels = classes(texts, each.count(), each.select("node", "fp"), **options)
    stays = each.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("class")).agg(F.min(F.struct("m.z", "m.d", "node", "m.row")).alias("k"))
    return marked.join(stays.select(F.col("k.row").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in names])
