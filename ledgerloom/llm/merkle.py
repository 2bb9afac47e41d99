"""Operator 8: document fingerprints as Merkle trees.

A text is cut into sections (at blank lines and before heading lines), paragraphs (lines) and leaves (sentences; long ones are cut after words chosen by
their hash, so an insertion shifts no later cut). Cuts partition the text: every code point is in one leaf. A node hashes its children, so equal roots
mean equal texts, and differing branches lead to the edit.

A fingerprint is the tree: root/sections, sections joined by "|"; a section is its hash, ":" and its paragraphs joined by ";"; a paragraph is its hash and
its leaves' (8 hex digits each, 32 for the root). likeness() and differences() work on fingerprints alone. differences() compares roots, then sections, and
descends only into sections whose hash the other tree lacks; children are aligned by hash, so what an insertion moves down is no difference.

Edge cases: a null text is empty, an empty text has a root and no leaf; two empty texts are alike to 1, an empty and another to 0; null doc_ids come
last in descending order; rows that repeat a doc_id are ordered by their text's hash, rows equal in both are interchangeable; bytes that aren't UTF-8 count
as U+FFFD; a text of any length is one row in one task; a table of one row has that row as its next; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from itertools import zip_longest
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_text, text_batches, text_parts

LEAF = re.compile(r"[^.!?]*+[.!?]*+\s*+")
WORDS = re.compile(r"\S*+\s*+")
LONG = 120


def _leaves(line: str) -> list[str]:
    out = []
    for s in LEAF.findall(line):
        if len(s) <= LONG:
            if s:
                out.append(s)
            continue
        start = at = 0
        for w in WORDS.findall(s):
            at += len(w)
            if w and zlib.crc32(w.encode("utf-8", "surrogatepass")) & 7 == 0:
                out.append(s[start:at])
                start = at
        if start < len(s):
            out.append(s[start:])
    return out


def cut(text: str) -> list[list[list[str]]]:
    """Sections of paragraphs of leaves; joined they are the text."""
    sections: list[list[list[str]]] = []
    blank = True
    for line in text.split("\n"):
        empty = not line.strip()
        if not sections or (blank and not empty) or line.startswith("#"):
            sections.append([])
        sections[-1].append(_leaves(line + "\n"))
        blank = empty
    if sections:
        last = sections[-1][-1]
        if last and last[-1].endswith("\n"):
            last[-1] = last[-1][:-1]
            if not last[-1]:
                last.pop()
    return sections


def fingerprint(text: str | None) -> str:
    h, parts, nodes = hashlib.sha256, [], []
    for section in cut(text or ""):
        paragraphs, inner = [], []
        for leaves in section:
            each = [h(b"\0" + x.encode("utf-8", "surrogatepass")).digest() for x in leaves]
            inner.append(h(b"\1" + b"".join(each)).digest())
            paragraphs.append("".join([x[:4].hex() for x in (inner[-1], *each)]))
        nodes.append(h(b"\2" + b"".join(inner)).digest())
        parts.append(nodes[-1][:4].hex() + ":" + ";".join(paragraphs))
    return h(b"\3" + b"".join(nodes)).hexdigest()[:32] + "/" + "|".join(parts)


def _counts(fp: str) -> Counter:
    s = "".join([p[8:] for section in fp[33:].split("|") for p in section[9:].split(";")])
    return Counter([s[i : i + 8] for i in range(0, len(s), 8)])


def likeness(a: str, b: str, ca: Counter | None = None, cb: Counter | None = None) -> float:
    """1 for equal roots, else the share of leaves that both have (twice the common over all), under 1."""
    if a[:32] == b[:32]:
        return 1.0
    ca, cb = ca or _counts(a), cb or _counts(b)
    n = ca.total() + cb.total()
    if len(ca) > len(cb):
        ca, cb = cb, ca
    common = sum(min(k, cb[x]) for x, k in ca.items() if x in cb)
    return min(2 * common / n, 1 - 1 / (n + 1)) if n else 0.0


class Edits(NamedTuple):
    """Places (section, paragraph) of the first tree without a counterpart in the second, of the second without one in the first, and pairs of places whose
    branch is in both, but out of order; a paragraph of None is a whole section."""

    gone: list[tuple[int, int]]
    new: list[tuple[int, int]]
    moved: list[tuple[tuple[int, int | None], tuple[int, int | None]]]


def _chain(y: list[int]) -> set[int]:
    """Indices of a longest increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(y):
        k = bisect_left(tops, v)
        tops[k:] = [v, *tops[k + 1 :]] if k < len(tops) else [v]
        at[k:] = [i, *at[k + 1 :]] if k < len(at) else [i]
        back.append(at[k - 1] if k else -1)
    out, i = set(), at[-1] if at else -1
    while i >= 0:
        out.add(i)
        i = back[i]
    return out


def _aligned(x: list[str], y: list[str]) -> tuple[list[tuple[int | None, int | None]], list[tuple[int, int]]]:
    """Children by hash: (what differs, what moved). Differing ones are paired in order where they lie between the same two that stayed."""
    places: dict[str, deque] = defaultdict(deque)
    for j, h in enumerate(y):
        places[h].append(j)
    same = [(i, places[h].popleft()) for i, h in enumerate(x) if places[h]]
    stay = _chain([j for _, j in same])
    anchors = [p for k, p in enumerate(same) if k in stay]
    moved = [p for k, p in enumerate(same) if k not in stay]
    own, other, out = {i for i, _ in same}, {j for _, j in same}, []
    for (a, b), (c, d) in zip([(-1, -1), *anchors], [*anchors, (len(x), len(y))]):
        out += zip_longest((i for i in range(a + 1, c) if i not in own), (j for j in range(b + 1, d) if j not in other))
    return out, moved


def differences(a: str, b: str) -> Edits:
    """Where two texts differ, by their fingerprints."""
    found = Edits([], [], [])
    if a[:32] == b[:32]:
        return found
    x, y = a[33:].split("|"), b[33:].split("|")
    differ, moved = _aligned([s[:8] for s in x], [s[:8] for s in y])
    found.moved.extend(((i, None), (j, None)) for i, j in moved)
    for i, j in differ:
        p, q = (s[9:].split(";") if s is not None else [] for s in (None if i is None else x[i], None if j is None else y[j]))
        inner, shifted = _aligned([s[:8] for s in p], [s[:8] for s in q])
        found.gone.extend((i, k) for k, _ in inner if k is not None)
        found.new.extend((j, k) for _, k in inner if k is not None)
        found.moved.extend(((i, k), (j, n)) for k, n in shifted)
    return found


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)])], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each document."""
    text_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_text().alias("text"))
    return narrow.mapInArrow(_fingerprints, "doc_id bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third replaced by the beginning of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_gone bigint, n_new bigint, n_moved bigint"
KINDS = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _next_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, tail, doc_id, text) in order: each row with the one after it; a range's tail row, or rows, stand for what follows its last."""
    names, kinds = zip(*(x.split() for x in RESULT.split(", ")))
    before, at = None, None  # (doc_id, text, fingerprint, leaves) that waits for its next, and its range
    for b in batches:
        out = []
        for r, tail, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            text = text or ""
            if r != at:
                before, at = None, r
            if tail and before is None:
                continue
            fp = fingerprint(text)
            leaves = _counts(fp)
            if before is not None:
                d, t, f, c = before
                e = edited(t, text)
                g = fingerprint(e)
                out.append((d, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f, g, likeness(f, g, c), likeness(f, fp, c, leaves), *map(len, differences(f, g))))
            before = None if tail else (doc, text, fp, leaves)
        cols = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), KINDS[k]) for c, k in zip(cols, kinds)], names=names)


class Ranges:
    """Ranges of the order (null ids last, descending doc_id as its complement, hash of the text) by the first row of each."""

    def __init__(self, firsts: list[tuple[int, int | None, int]]):
        self.n = len(firsts)
        known = [(k, h) for z, k, h in firsts if not z]
        self.k, self.h = (np.array([x[i] for x in known], np.int64) for i in (0, 1))
        self.null = np.array([h for z, _, h in firsts if z], np.int64)

    def of(self, z: np.ndarray, k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and whether it begins it."""
        lo, hi = np.searchsorted(self.k, k, "left"), np.searchsorted(self.k, k, "right")
        out, begins = hi - 1, np.zeros(len(k), bool)
        for i in np.flatnonzero((lo < hi) & (z == 0)):
            out[i] = lo[i] - 1 + np.searchsorted(self.h[lo[i] : hi[i]], h[i], "right")
            begins[i] = out[i] >= lo[i] and self.h[out[i]] == h[i]
        for i in np.flatnonzero(z):
            at = int(np.searchsorted(self.null, h[i], "right"))
            out[i] = len(self.k) + at - 1
            begins[i] = at > 0 and self.null[at - 1] == h[i]
        return out, begins


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every document with its edit by, and likeness to, the next by descending doc_id, and how many branches differ between it and its edit (gone, new,
    moved). Documents are dealt once, by ranges of the order; the first row of each range is sent to the range before it as well. Ranges are found by dealing
    ids and hashes alone; the driver gets one of those for each range, and a range of rows goes to a task of its own."""
    text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(own_text(), F.lit("")).alias("text"))
    rows = rows.select(F.col("doc_id").isNull().cast("int").alias("z"), F.bitwise_not("doc_id").alias("k"), F.xxhash64("text").alias("h"), "doc_id", "text")
    n = text_parts(rows)
    firsts = rows.select("z", "k", "h").repartitionByRange(n, "z", "k", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("z", "k", "h")).alias("first")).collect()
    ranges = Ranges(sorted({tuple(r["first"]) for r in firsts}, key=lambda x: (x[0], x[1] or 0, x[2])))
    names = ["range", "tail", "z", "k", "h", "doc_id", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, begins = ranges.of(b.column(0).to_numpy(), b.column(1).fill_null(0).to_numpy(), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(np.zeros(len(r), np.int32)), *b.columns], names=names)
            if begins.any():  # the first range's first row follows the last range
                again = b.filter(pa.array(begins))
                yield pa.RecordBatch.from_arrays([pa.array((r[begins] - 1) % ranges.n, pa.int32()), pa.array(np.ones(again.num_rows, np.int32)), *again.columns], names=names)

    dealt = rows.mapInArrow(deal, "range int, tail int, z int, k bigint, h bigint, doc_id bigint, text string").repartitionById(max(1, ranges.n), F.col("range"))
    dealt = dealt.sortWithinPartitions("range", "tail", "z", "k", "h").select("range", "tail", "doc_id", "text")
    return dealt.mapInArrow(_next_rows, RESULT)
