"""Operators 2 and 4 against plain versions."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, resharding


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(sizes):
    total, done = sum(sizes), {}
    while True:
        left = [i for i in range(len(sizes)) if i not in done]
        rest, w = total - sum(done.values()), sum((5, 2, 1)[i % 3] for i in left)
        share = {i: rest * (5, 2, 1)[i % 3] / w for i in left}
        over = [i for i in left if share[i] > 3 * sizes[i]]
        if not over:
            return [done.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        done.update({i: 3.0 * sizes[i] for i in over})


def check_mix(spark, df):
    docs = [(r.doc_id, r.source, n_words(r.text)) for r in df.collect()]
    got = mixing.op2(spark, df).collect()
    assert Counter((r.doc_id, r["source"], r["size"]) for r in got) == Counter(docs)
    sizes = defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    want = dict(zip(names, plain_targets([sizes[s] for s in names])))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r["source"]] and abs(r.target - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r["source"]] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.op2(spark, df.repartition(5)).collect()))


def test_mix(spark, tiny, odd, none):
    check_mix(spark, tiny)
    check_mix(spark, odd)
    assert mixing.op2(spark, none).count() == 0
    assert mixing.mixed_documents(none).count() == 0


def plain_taken(docs, block=1024):
    """Words taken of each (doc_id, source, text) by walking the schedule slot by slot over lists of words."""
    names = sorted({s for _, s, _ in docs if s is not None}) + [None] * any(s is None for _, s, _ in docs)
    words = {s: [k for k in sorted((d is not None, d or 0, n_words(t), i) for i, (d, x, t) in enumerate(docs) if x == s) for _ in range(k[2])] for s in names}
    goal = plain_targets([len(words[s]) for s in names])
    budget = [min(round(g), 3 * len(words[s])) for g, s in zip(goal, names)]
    each = [(b // len(words[s]) if words[s] else 0, b % len(words[s]) if words[s] else 0, -(-len(words[s]) // block)) for b, s in zip(budget, names)]
    slots = [e * n + -(-r // block) for e, r, n in each]
    total, taken, rank, i = sum(slots), Counter(), [0] * len(names), 0
    edge = [mixing.MODULUS * sum(slots[:k]) // max(total, 1) for k in range(len(names) + 1)]
    while any(r < n for r, n in zip(rank, slots)):
        x = i * mixing.MULTIPLIER % mixing.MODULUS
        k = max(j for j in range(len(names)) if edge[j] <= x and slots[j] > 0 or j == 0)
        i += 1
        if i > total + len(names):
            k = next(j for j in range(len(names)) if rank[j] < slots[j])
        if rank[k] >= slots[k]:
            continue
        own, n = words[names[k]], each[k][2]
        epoch, at = divmod(rank[k], n)
        full = len(own) // block
        b = at if at >= full else int(mixing.shuffled(np.array([at]), full, k + 1)[0])
        left = budget[k] - epoch * len(own) - at * block
        rank[k] += 1
        taken.update(own[b * block : b * block + max(0, min(block, left))])
    return [taken[(d is not None, d or 0, n_words(t), i)] for i, (d, _, t) in enumerate(docs)], budget


def test_taken_words_one_by_one(spark, tiny):
    """Words of one document may change places with those of another with the same id only; ids are unique here."""
    docs = [(r.doc_id, r.source, r.text) for r in tiny.collect()]
    want, budget = plain_taken(docs)
    got = {r.doc_id: r.taken for r in mixing.op2(spark, tiny).collect()}
    assert got == {d: n for (d, _, _), n in zip(docs, want)} and sum(want) == sum(budget)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té", max_size=60), st.lists(st.tuples(st.integers(0, 20), st.integers(1, 6)), min_size=1, max_size=3))
def test_cuts_keep_line_ends(text, spans):
    words = text.encode().split()
    spans = [(a, min(a + n, len(words))) for a, n in spans if a < len(words)]
    want = [w for k, w in enumerate(words) if any(a <= k < b for a, b in spans)]
    got = mixing.cut(text.encode(), spans)
    assert got.split() == want and (len(spans) != 1 or got in text.encode())


def test_mixed_documents(spark, tiny, odd):
    for df in (tiny, odd):
        taken = mixing.op2(spark, df).groupBy("doc_id").agg(F.sum("taken").alias("n"))
        want = {r.doc_id: r.n for r in taken.collect()}
        mixed = mixing.mixed_documents(df)
        assert mixed.schema == df.schema
        got = defaultdict(int)
        texts = defaultdict(set)
        for r in df.collect():
            texts[r.doc_id].add(r.text)
        for r in mixed.collect():
            got[r.doc_id] += n_words(r.text)
            assert any((r.text or "") in (t or "") or set((r.text or "").split()) <= set((t or "").split()) for t in texts[r.doc_id])
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_mixed_rows_keep_their_columns(spark):
    """Rows alike in id, source and text but not in another column stay apart."""
    docs = spark.createDataFrame([(1, "one two three", lang, "s", n) for lang, n in (("en", 1), ("fr", 1), (None, 1), ("en", None))] + [(2, "four five", "en", "s", 1)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.lang, r.n_chars) for r in mixing.mixed_documents(docs).collect())
    assert set(got) == {(1, "en", 1), (1, "fr", 1), (1, None, 1), (1, "en", None), (2, "en", 1)} and got[2, "en", 1] == 2


def test_schedule_is_low_discrepancy(spark):
    src = [mixing.Source(i, n, t, 16) for i, (n, t) in enumerate([(4000, 9000.0), (9000, 3000.0), (50, 150.0), (0, 0.0), (30_000, 7777.0)])]
    rows = mixing.schedule(spark, src).orderBy("slot").collect()
    assert len({r.slot for r in rows}) == len(rows)
    total, words = sum(s.budget for s in src), 0
    per, ranks = Counter(), defaultdict(list)
    for r in rows:
        words += r.words
        per[r.source_no] += r.words
        ranks[r.source_no].append(r["rank"])
        for s in src:
            assert abs(per[s.index] - words * s.budget / total) < 8 * 16
    assert all(per[s.index] == s.budget and sorted(ranks[s.index]) == list(range(s.slots)) for s in src)
    for s in src:
        for e in {r.epoch for r in rows if r.source_no == s.index}:
            blocks = [r.block for r in rows if r.source_no == s.index and r.epoch == e]
            assert len(set(blocks)) == len(blocks) and (not blocks or max(blocks) < s.blocks)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 300), st.integers(0, mixing.MODULUS))
def test_points_below(n, cut):
    assert mixing.points_below(n, cut) == sum(i * mixing.MULTIPLIER % mixing.MODULUS < cut for i in range(n))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 500), st.integers(0, 99))
def test_shuffle_is_a_permutation(n, seed):
    assert sorted(mixing.shuffled(np.arange(n), n, seed)) == list(range(n))


# --- 4


def check_shards(spark, df):
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = resharding.op4(spark, df).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in docs)
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)
    slots, loads = defaultdict(list), [0] * 16
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < 16 for s in slots)
    return loads, got


def test_shards(spark, odd, none):
    small = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    loads, got = check_shards(spark, small)
    mean = sum(loads) / 16
    assert max(loads) - min(loads) < 0.1 * mean, loads
    again = Counter(map(tuple, resharding.op4(spark, small.repartition(7)).collect()))
    assert again == Counter(map(tuple, got))
    old = defaultdict(int)
    for r in got:
        old[r.old_shard] += r["size"]
    fewest = sum(max(0, n - mean) if o < 16 else n for o, n in old.items())
    moved = sum(r["size"] for r in got if r.old_shard != r.shard)
    assert moved <= fewest * 1.1 + 0.1 * mean
    check_shards(spark, odd)
    assert resharding.op4(spark, none).count() == 0


def stored_shards(df, path, n):
    """df written as shard=0 ... n - 1."""
    df.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(n)).cast("int")).repartition(3).write.partitionBy("shard").parquet(path)


def test_rewrite_in_place(spark, odd, tmp_path):
    """Every row with all its columns is in one shard; shards that neither lose nor gain keep their very files."""
    path = str(tmp_path / "shards")
    docs = odd.drop("shard", "_row").withColumn("lang", F.coalesce("lang", F.lit("x")))
    stored_shards(docs, path, 5)
    rows = spark.read.parquet(path).withColumn("old_shard", F.col("shard")).drop("shard")
    how = resharding.plan(rows, "old_shard", 5)
    before = {f.name for f in tmp_path.glob("shards/shard=*/*.parquet")}
    affected = resharding.rewrite(rows, "old_shard", how, path)
    assert affected == how.affected() and affected
    back = spark.read.parquet(path)
    names = docs.columns
    assert Counter(map(str, back.select(names).collect())) == Counter(map(str, docs.select(names).collect()))
    kept = {f.name for f in tmp_path.glob("shards/shard=*/*.parquet")} & before
    assert kept == {f.name for f in tmp_path.glob("shards/shard=*/*.parquet") if int(f.parent.name[6:]) not in affected}


def test_rewrite_leaves_other_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    docs = spark.createDataFrame([(None if i == 7 else i, "x" * 99 if i % 3 < 2 else "y" * (99 if i % 2 else 9), i) for i in range(300)] + [(4, "x" * 99, 1), (4, "x" * 99, 2), (None, "x" * 99, 3)], "doc_id long, text string, place int")
    docs = docs.withColumn("shard", F.when(F.col("doc_id").isNull(), 0).otherwise(F.pmod("doc_id", F.lit(3))).cast("int"))
    docs.write.partitionBy("shard").parquet(path)
    rows = spark.read.parquet(path).withColumnRenamed("shard", "old")
    how = resharding.plan(rows, "old", 3)
    how.runs = [r for r in how.runs if r[0] != 1 or r[2] == 1]  # as if shard 1 were at the level
    files = {f for f in tmp_path.glob("shards/shard=1/*.parquet")}
    assert resharding.rewrite(rows, "old", how, path) == [0, 2]
    assert {f for f in tmp_path.glob("shards/shard=1/*.parquet")} == files
    back = spark.read.option("mergeSchema", "true").parquet(path)
    assert Counter((r.doc_id, r.text, r.place) for r in back.collect()) == Counter((r.doc_id, r.text, r.place) for r in docs.collect())
    got = resharding.with_slots(back.filter("shard <> 1"), "shard", "_place").collect()
    for s in (0, 2):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        ids = [r.doc_id for r in sorted((r for r in got if r.shard == s), key=lambda r: r.slot)]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_shards_that_go(spark, tiny):
    docs = tiny.withColumn("old", F.pmod(F.col("doc_id"), F.lit(9)).cast("int"))
    how = resharding.plan(docs, "old", 4)
    assert how.emptied() == [4, 5, 6, 7, 8] and how.affected() == [0, 1, 2, 3]
    got = how.shard_of(docs, "old", "new").collect()
    loads = [sum(len(r.text.encode()) + 1 for r in got if r.new == j) for j in range(4)]
    assert len(got) == tiny.count() and max(loads) - min(loads) < 0.2 * sum(loads) / 4


def fewest_moved(supply, demand, cost):
    """By trying every split of a source's units."""
    best = [None]

    def go(i, room, spent):
        if best[0] is not None and spent >= best[0]:
            return
        if i == len(supply):
            best[0] = spent
            return
        for split in product(*(range(min(r, supply[i]) + 1) for r in room)):
            if sum(split) == supply[i]:
                go(i + 1, [r - x for r, x in zip(room, split)], spent + sum(x * cost(i, j) for j, x in enumerate(split)))

    go(0, demand, 0)
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=3), st.integers(1, 3), st.lists(st.integers(0, 5), min_size=9, max_size=9), st.randoms())
def test_min_cost_flow(supply, sinks, costs, r):
    demand = [0] * sinks
    for _ in range(sum(supply)):
        demand[r.randrange(sinks)] += 1
    cost = lambda i, j: costs[i * 3 + j]
    flow = resharding.min_cost_flow(supply, demand, cost)
    assert [sum(n for (i, _), n in flow.items() if i == k) for k in range(len(supply))] == supply
    assert [sum(n for (_, j), n in flow.items() if j == k) for k in range(sinks)] == demand
    assert sum(n * cost(*k) for k, n in flow.items()) == fewest_moved(supply, demand, cost)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 300))
def test_level(loads, total):
    out = resharding.level(loads, total)
    assert sum(out) == total and min(out) >= 0
    tops = [a + b for a, b in zip(loads, out)]
    assert all(t - 1 <= min(tops) or not o for t, o in zip(tops, out))
