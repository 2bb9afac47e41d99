"""Near-dedup against all pairs in plain Python."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import near_dedup
from ledgerloom.llm.common import whole_groups
from tests.llm.test_pipeline import sets, similarity
from tests.llm.test_searches import plain_fingerprint

RNG = np.random.default_rng


def word(rng):
    return "w%d" % rng.integers(10**9)


def families(seed, sizes, words, edits):
    rng, docs = RNG(seed), []
    for size in sizes:
        base = [word(rng) for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for at in rng.integers(0, words, rng.integers(0, edits + 1)):
                w[at] = word(rng)
            docs.append(" ".join(w))
    return [(int(i), docs[k]) for i, k in enumerate(rng.permutation(len(docs)))]


def plain_kept(docs):
    """The least id of each component of pairs at 0.8."""
    info = [sets(t) for _, t in docs]
    comp = list(range(len(docs)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, x in enumerate(info):
        for j, y in enumerate(info[:i]):
            if similarity(x, y) >= 0.8:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return set(least.values())


def kept(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return {r.doc_id for r in near_dedup.unique(df, **options).collect()}


def test_crowded_keys_lose_no_pair(spark):
    docs = families(1, [40, 40, 30], 200, 12)
    expected = plain_kept(docs)
    for options in ({"limit": 4, "rounds": 1, "block": 8}, {"limit": 4, "rounds": 0, "block": 8}):
        assert kept(spark, docs, **options) == expected


def test_every_member_is_compared(spark):
    docs = families(2, [20] * 12, 300, 10)
    assert kept(spark, docs) == plain_kept(docs)


def test_dense_groups_are_joined_before_all_pairs(spark, monkeypatch):
    """One group around 0.8: stars join nearly all of it, so the last comparison is left with few of its pairs, and the result is that of all pairs."""
    made, meet = [], near_dedup._meet_all

    def counted(*args):
        pairs = meet(*args)
        made.append(pairs.distinct().count())
        return pairs

    docs = families(11, [150], 150, 9)
    monkeypatch.setattr(near_dedup, "_meet_all", counted)
    assert kept(spark, docs) == plain_kept(docs)
    assert made[0] < 150 * 149 / 2 / 20


def test_sketches_lose_no_pair():
    """The buckets that differ are never more than the sets' difference, and nearly as many while sets are small."""
    rng = RNG(12)
    for size in (0, 1, 5, 180, 1000, 20000):
        for share in (0, 0.05, 0.12, 0.5, 1):
            a = rng.integers(0, 2**63, size, np.uint64) * np.uint64(2)
            b = a.copy()
            new = int(size * share)
            b[:new] = rng.integers(0, 2**63, new, np.uint64) * np.uint64(2) + np.uint64(1)
            s = near_dedup._sketches([near_dedup.sketch(a), near_dedup.sketch(np.r_[b, b[:3]])])
            apart, sizes, row = int(np.bitwise_count(s[0] ^ s[1]).sum()), np.array([len(set(a.tolist())), len(set(b.tolist()))]), np.array([0])
            assert apart <= 2 * new and (apart - 2 * new) % 2 == 0
            if size <= 180:
                assert apart >= 2 * new * 0.8
            common = size - new
            if size and common >= 0.8 * (2 * size - common):
                assert near_dedup._near(s, sizes, row, row + 1, 0.8)[0]


def tails(seed, n, words, share):
    """n pairs of a text and the same with a new tail, of similarity `share` or a little more."""
    rng, docs = RNG(seed), []
    for _ in range(n):
        w = [word(rng) for _ in range(words)]
        new = int((words - 4) * (1 - share) / (1 + share))
        docs += [" ".join(w), " ".join(w[: words - new] + [word(rng) for _ in range(new)])]
    return [(i, t) for i, t in enumerate(docs)]


def test_all_pairs_at_any_bits(spark):
    docs = tails(3, 120, 60, 0.8) + [(i + 1000, t) for i, t in tails(4, 40, 300, 0.8)]
    got = kept(spark, docs)
    assert got == plain_kept(docs)
    assert len(got) == len(docs) // 2


def boilerplate():
    rng = RNG(5)
    line = " ".join(word(rng) for _ in range(9))
    return [(i, " ".join([line] * 20 + [word(rng) for _ in range(60)])) for i in range(12)]


def test_alike_fingerprints_alone_join_nothing(spark):
    docs = boilerplate() + [(100, boilerplate()[0][1]), (101, None), (102, "")]
    assert len({plain_fingerprint(t, 5) for _, t in boilerplate()}) < 12
    assert kept(spark, docs) == kept(spark, docs, close=0) == plain_kept(docs) == {*range(12), 101}


@pytest.mark.parametrize("sent", [0, 10**6])
def test_chains_join(spark, sent):
    """Each text is near its neighbour only; ids run against the chain."""
    rng = RNG(9)
    w, docs = [word(rng) for _ in range(200)], []
    for i in range(40):
        w = [*w[8:], *(word(rng) for _ in range(8))]
        docs.append((100 - i, " ".join(w)))
    docs += [(500, "alone and apart from all of them")]
    assert kept(spark, docs, sent=sent, limit=3) == plain_kept(docs) == {61, 500}


def clusters_by_counting(docs):
    """Least ids by all pairs with a common shingle, counted over postings: every pair at 0.8 is among them."""
    number, postings, rows = {}, [], []
    for i, (_, t) in enumerate(docs):
        row = sorted(number.setdefault(s, len(number)) for s in sets(t))
        for k in row:
            if k == len(postings):
                postings.append([])
            postings[k].append(i)
        rows.append(row)
    postings, size, comp = [np.array(p) for p in postings], np.array([len(r) for r in rows]), list(range(len(docs)))
    pairs = 0
    for i, row in enumerate(rows):
        if not row:
            alike = [j for j in range(i) if not rows[j]]
        else:
            n = np.bincount(np.concatenate([postings[k] for k in row]), minlength=len(rows))
            alike = np.flatnonzero(n[:i] >= 0.8 * (size[:i] + size[i] - n[:i])).tolist()
        for j in alike:
            pairs += rows[i] != rows[j]
            a, b = i, j
            while comp[a] != a:
                a = comp[a]
            while comp[b] != b:
                b = comp[b]
            comp[max(a, b)] = min(a, b)
    roots = [i for i in range(len(docs)) if comp[i] == i]
    return {docs[i][0] for i in roots}, pairs


def test_recall_on_the_large_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect())
    want, pairs = clusters_by_counting(docs)
    assert pairs > 40
    assert {r.doc_id for r in near_dedup.unique(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("doc_id").collect()} == want


def test_shared_entries_in_any_batches():
    rng = RNG(1)
    for _ in range(200):
        key = np.sort(rng.integers(0, 6, rng.integers(0, 12)))
        cuts = np.sort(rng.integers(0, len(key) + 1, 3))
        parts = [pa.RecordBatch.from_arrays([pa.array(p), pa.array(p * 10)], names=["key", "node"]) for p in np.split(key, cuts)]
        got = [k for b in near_dedup._shared(iter(parts)) for k in b.column(0).to_pylist()]
        assert sorted(got) == [k for k in key.tolist() if (key == k).sum() > 1]
        whole = [g[0].tolist() for g in whole_groups(iter(parts), 1)]
        assert sum(whole, []) == key.tolist() and all(not set(a) & set(b) for a, b in zip(whole, whole[1:]))
