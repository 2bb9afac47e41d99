"""Operator 11 against counting all strings."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import suffix_levels
from tests.llm.conftest import SCHEMA


def plain(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept digest) of each text, by a table of all strings."""
    where = Counter()
    texts = [t or b"" for t in texts]
    for t in texts:
        for i in range(len(t) - length + 1):
            where[t[i : i + length]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if where[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def same(spark, docs):
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).collect()
    want = Counter((r.doc_id, *p) for r, p in zip(rows, plain([None if r.text is None else bytes(r.text) for r in rows])))
    got = Counter(tuple(r) for r in suffix_levels.op11(spark, docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want
    return got


def test_odd_rows(spark, odd):
    assert any(r[2] for r in same(spark, odd))


def test_empty_table(spark, none):
    assert suffix_levels.op11(spark, none).collect() == []


def test_bytes_that_are_no_text(spark, torn):
    same(spark, torn)


def test_given_table(spark, tiny):
    assert any(0 < r[2] < r[1] for r in same(spark, tiny))


def cut_and_pasted(seed, n=60):
    """Texts of one alphabet with passages of every length about the limit, cut, shifted and overlapping."""
    r = random.Random(seed)
    say = lambda k: "".join(r.choice("ab c") for _ in range(k))
    pool = [say(r.choice((199, 200, 201, 230, 336, 337, 600))) for _ in range(6)] + ["a" * 450, "ab" * 260, say(64) * 8]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(pool)
            lo = r.randint(0, max(0, len(p) - 180))
            parts += [say(r.randint(0, 150)), p[lo : lo + r.randint(150, 500)]]
        texts.append("".join(parts))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(2))
def test_passages_about_the_limit(spark, seed):
    same(spark, spark.createDataFrame(cut_and_pasted(seed), "doc_id long, text string").repartition(3))


def test_both_ways_to_reach_texts(spark):
    docs = spark.createDataFrame(cut_and_pasted(9), "doc_id long, text string")
    rows = lambda sent: Counter(str(r) for r in suffix_levels.trimmed(docs, sent=sent).collect())
    assert rows(1) == rows(10**6)


def test_blocks_of_long_texts(spark, monkeypatch):
    """Runs that a block's end cuts are still found."""
    import numpy as np

    r = random.Random(3)
    a, b = (bytes(r.choice(b"abcd") for _ in range(3000)) for _ in range(2))
    texts = [a + b[:700] + a[500:1900], b[300:2000] + a[100:900]]
    want = plain(texts)
    monkeypatch.setattr(suffix_levels, "BLOCK", 333)
    data = b"".join(texts)
    inside = np.zeros(len(data) - 199, bool)
    inside[: len(texts[0]) - 199], inside[len(texts[0]) :] = True, True
    windows = Counter()
    for lo, n, _, _ in suffix_levels.runs_of(np.frombuffer(data, np.uint8), inside, suffix_levels.Hasher(600), 200, 64):
        for x, k in zip(lo.tolist(), n.tolist()):
            windows.update(range(x, x + k))
    assert set(windows) == set(np.flatnonzero(inside).tolist()) and set(windows.values()) == {1}
    docs = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "doc_id long, text binary")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_levels.op11(spark, docs).collect()}
    assert [got[0], got[1]] == want


def test_levels_grow_geometrically(spark):
    """Seven batches leave levels of 1, 2 and 4; what two batches share is found when the second comes, at any distance."""
    family, common = suffix_levels.Levels(spark), {}
    for k in range(7):
        names = [1000 + k, 1000 + k, 2000 + k] + [-i for i in range(k)]  # one twice in the batch, one alone, -i in all batches after i
        family.add(spark.createDataFrame([(x,) for x in names], "name long"))
        common[k] = {r.name for r in family.shared().collect()}
        assert common[k] == {1000 + i for i in range(k + 1)} | {-i for i in range(k - 1)}
    assert sorted(family.levels) == [0, 1, 2]
    sizes = {r: family.table(p).agg(F.sum("n")).first()[0] for r, p in family.levels.items()}
    assert sum(sizes.values()) == sum(3 + k for k in range(7)) and sizes[0] == 9


def test_one_text_in_a_third_of_all_rows(spark):
    rows = cut_and_pasted(4, 40)
    rows += [(100 + i, rows[1][1]) for i in range(20)] + [(7, rows[7][1])] * 3
    same(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_clashing_columns(spark):
    extra = SCHEMA + ", name int, content int, at int, hits int, batch int, core int, windows int"
    docs = spark.createDataFrame([(1, "x" * 300, "en", "s", 1, *[None] * 27), (2, None, *[None] * 30)], extra)
    assert {(r.doc_id, r.n_removed) for r in suffix_levels.op11(spark, docs).collect()} == {(1, 300), (2, 0)}
