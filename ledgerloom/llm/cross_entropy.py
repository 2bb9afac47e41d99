"""Operator 5: cross-entropy difference of matched n-gram models.

Target (documents labelled good and not toxic) and background (all documents) each get a bigram model over the ids of one public vocabulary, smoothed
alike: P(w|h) = (c(h,w) + mu P(w)) / (c(h) + mu), P(w) = (c(w) + alpha) / (N + alpha V). A document's score is the mean over its tokens of target loss
minus background loss: the lower, the more it is like the target.

Counts cover every token of every document and nothing is pruned. Documents are encoded once, in chunks of a bounded number of tokens; each chunk says
which bigrams it has and how often. The sums over chunks are the counts (a row for each bigram, never broadcast); the losses of a chunk's bigrams come
back to it by a join on bigrams and meet its documents by chunk. Only tables of the vocabulary's size are broadcast. No key holds more than a row for
each chunk (2 million tokens), and the join is one of two plain exchanges, so adaptive execution splits a frequent bigram's rows.

Target ids reach the texts in one of two ways with the same rows: as plain numbers sent to every task, up to BROADCAST_IDS (64 MB), so texts don't move; beyond
that by a join that deals the texts by doc_id, as numbers without a bound can't be sent and moving texts always would double the disk. Tests run both.

Edge cases: a null text is empty; a document without tokens has n_tokens 0 and null entropies and score; null doc_ids are kept and are background;
repeated documents count as often as they occur, repeated labels once; without labels the target model is uniform; texts of any length are read whole, bytes
that aren't UTF-8 count as U+FFFD; equal texts have equal scores; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, own_text, text_batches, written
from .encoding import array_slices, encoder, vocabulary_path

#: Target ids up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 8_000_000
CHUNK_SCHEMA = "chunk bigint, doc_id bigint, n_tokens bigint, ids binary, keys binary, n_all binary, n_target binary"


def bigram_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """history * (size + 1) + token; the history of a first token is `size`."""
    h = np.r_[np.array([size], np.int64), ids[:-1]] if len(ids) else ids
    return h * (size + 1) + ids


def _chunks(batches: Iterator[pa.RecordBatch], file: str, size: int, most: int, handle) -> Iterator[pa.RecordBatch]:
    """Documents with their ids by chunk, and a row for each chunk with its bigrams."""
    enc, pack = encoder(file), zstandard.ZstdCompressor(level=1)
    docs: list = []
    number, held = TaskContext.get().partitionId() << 24, 0

    def flush():
        nonlocal docs, number, held
        keys = [bigram_keys(ids, size) for _, ids, _ in docs]
        names, n = np.unique(np.concatenate(keys), return_counts=True)
        good, k = np.unique(np.concatenate([np.zeros(0, np.int64), *[x for x, (_, _, t) in zip(keys, docs) if t]]), return_counts=True)
        target = np.zeros(len(names), np.int64)
        target[np.searchsorted(names, good)] = k
        blobs = [pack.compress(x.tobytes()) for x in (names, n.astype(np.int64), target)]
        rows = [(number, d, len(ids), pack.compress(ids.astype("<i4").tobytes()), None, None, None) for d, ids, _ in docs] + [(number, None, -1, None, *blobs)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        docs, number, held = [], number + 1, 0
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])

    for b in batches:
        doc_ids, good = b.column(0).to_pylist(), b.column(2).to_pylist()
        if handle is not None and len(handle.value):
            own = np.array([x if x is not None else 0 for x in doc_ids], np.int64)
            found = handle.value[np.minimum(np.searchsorted(handle.value, own), len(handle.value) - 1)] == own
            good = [bool(f) and d is not None for f, d in zip(found, doc_ids)]
        for lo, hi in array_slices(b.column(1)):
            ids, at = enc.encode_array(b.column(1).slice(lo, hi - lo))
            for d, i, j, t in zip(doc_ids[lo:hi], at[:-1], at[1:], good[lo:hi]):
                docs.append((d, ids[i:j].astype(np.int64), t))
                held += int(j - i)
                if held >= most:
                    yield flush()
    if docs:
        yield flush()
    give_back()


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for chunk, *blobs in zip(*(b.column(i).to_pylist() for i in range(4))):
            cols = [_unpack(x, "<i8") for x in blobs]
            for lo in range(0, len(cols[0]), 1 << 16):
                part = [pa.array(c[lo : lo + (1 << 16)]) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), chunk)), *part], names=["chunk", "key", "n", "t"])


def _score(key: tuple, docs: pa.Table, losses: pa.Table, size: int) -> pa.Table:
    ids = [_unpack(x, "<i4").astype(np.int64) for x in docs["ids"].to_pylist()]
    n = np.array([len(x) for x in ids], np.int64)
    keys = np.concatenate([np.zeros(0, np.int64), *[bigram_keys(x, size) for x in ids]])
    names = losses["key"].to_numpy()
    order = np.argsort(names)
    at = order[np.searchsorted(names, keys, sorter=order)] if len(keys) else keys
    owner = np.repeat(np.arange(len(ids)), n)
    sums = [np.bincount(owner, losses[c].to_numpy()[at] if len(at) else None, len(ids)) for c in ("target", "background")]
    means = [np.divide(s, n, out=np.full(len(n), np.nan), where=n > 0) for s in sums]
    none = n == 0
    return pa.table({"doc_id": docs["doc_id"], "n_tokens": pa.array(n), **{k: pa.array(v, mask=none) for k, v in (("target_entropy", means[0]), ("background_entropy", means[1]), ("score", means[0] - means[1]))}})


def scores(docs: DataFrame, target_ids: DataFrame, vocabulary: str | None = None, mu: float = 64.0, alpha: float = 0.5, chunk_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, target_entropy, background_entropy (nats a token), score. target_ids: doc_id of the target's documents."""
    text_batches(docs.sparkSession)
    file = vocabulary or vocabulary_path()
    size = encoder(file).tokenizer.get_vocab_size()
    goal = target_ids.select(F.col("doc_id").cast("long").alias("_id")).filter("_id IS NOT NULL").distinct().withColumn("_t", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_text().cast("binary").alias("text"))
    # Flags reach the texts without moving them while the ids are few enough to send along as plain numbers; beyond that both sides are dealt by doc_id.
    handle = None
    if goal.count() <= BROADCAST_IDS:
        handle = docs.sparkSession.sparkContext.broadcast(np.sort(goal.select("_id").toArrow()["_id"].to_numpy()))
        rows = rows.select("doc_id", "text", F.lit(False).alias("good"))
    else:
        rows = rows.join(goal, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.coalesce("_t", F.lit(False)).alias("good"))
    chunks = written(rows.mapInArrow(lambda it: _chunks(it, file, size, chunk_tokens, handle), CHUNK_SCHEMA), "ngrams")
    bigrams = chunks.filter("n_tokens < 0").select("chunk", "keys", "n_all", "n_target").mapInArrow(_bigrams, "chunk bigint, key bigint, n bigint, t bigint")
    counts = bigrams.groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counts = written(counts.select("key", F.expr(f"key div {size + 1}").alias("h"), (F.col("key") % (size + 1)).alias("w"), "n", "t"), "bigrams")
    words = counts.groupBy(F.col("w").alias("_w")).agg(F.sum("n").alias("wn"), F.sum("t").alias("wt"))
    history = counts.groupBy(F.col("h").alias("_h")).agg(F.sum("n").alias("hn"), F.sum("t").alias("ht"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()

    def loss(c: str, w: str, h: str, all_: int):
        unigram = (F.col(w) + alpha) / (all_ + alpha * size)
        return -F.log((F.col(c) + mu * unigram) / (F.col(h) + mu))

    model = counts.join(F.broadcast(words), F.col("w") == F.col("_w")).join(F.broadcast(history), F.col("h") == F.col("_h"))
    model = model.select(F.col("key").alias("_key"), loss("t", "wt", "ht", total.t).alias("target"), loss("n", "wn", "hn", total.n).alias("background"))
    losses = bigrams.select("chunk", "key").join(model, F.col("key") == F.col("_key")).select("chunk", "key", "target", "background")
    texts = chunks.filter("n_tokens >= 0").select("chunk", "doc_id", "ids")
    return texts.groupBy("chunk").cogroup(losses.groupBy("chunk")).applyInArrow(lambda k, a, b: _score(k, a, b, size), "doc_id bigint, n_tokens bigint, target_entropy double, background_entropy double, score double")


def op5(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document against those labelled good and not toxic."""
    return scores(docs, labels.filter("quality = 1 AND toxic = 0"))
