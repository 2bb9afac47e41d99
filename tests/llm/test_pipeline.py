"""Near-dedup as a stage, and the pipeline stage by stage against plain versions."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import near_dedup, toxicity
from tests.llm.test_layouts import n_words
from tests.llm.test_searches import plain_contamination, plain_tokens


def sets(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_unique(docs, kept):
    """docs, kept: (doc_id, text). Of each component of pairs at a similarity of 0.8 or more one document stays, the one with the least id."""
    info = [sets(t) for _, t in docs]
    comp = list(range(len(docs)))

    def root(x):
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x

    for i, x in enumerate(info):
        for j, y in enumerate(info[:i]):
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and similarity(x, y) >= 0.8:
                comp[root(i)] = root(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(docs[i])
    got = Counter(kept)
    assert not got - Counter(docs)
    for g in groups.values():
        stays = [x for x in set(g) if got[x]]
        assert len(stays) == 1 and got[stays[0]] == 1
        assert stays[0][0] == min((d for d, _ in g if d is not None), default=None)


def test_one_of_each_group_stays(spark, tiny, odd, none):
    for df in (tiny, odd):
        docs = [(r.doc_id, r.text) for r in df.collect()]
        got = near_dedup.unique(df.repartition(3))
        assert got.schema == df.schema
        check_unique(docs, [(r.doc_id, r.text) for r in got.collect()])
    assert near_dedup.unique(none).count() == 0


@pytest.mark.parametrize("options", [{}, {"limit": 4, "block": 8}, {"limit": 4, "rounds": 0, "block": 8, "sent": 0}])
def test_crowds_of_near_copies(spark, options):
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(10**9)
    rows, n = [], 0
    for size in (70, 20, 1, 1, 1, 1):
        base = [word() for _ in range(300)]
        for _ in range(size):
            w = list(base)
            for at in rng.integers(0, 300, rng.integers(0, 5)):
                w[at] = word()
            rows.append((n, " ".join(w), "x"))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = [(r.doc_id, r.text) for r in near_dedup.unique(df, **options).collect()]
    check_unique([r[:2] for r in rows], kept)
    assert len(kept) == 6


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    before, frames = docs, []
    for n in names[:-1]:
        df = stage[n](spark, before, sf).cache()
        assert df.schema == docs.schema
        frames.append(df)
        before = df
    calm, unique, clean, mixed = frames
    chain = toxicity.train_chain(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, chain).filter("toxic").collect()}
    assert Counter(pairs(calm)) == Counter(x for x in pairs(docs) if x[0] not in bad)
    check_unique(pairs(calm), pairs(unique))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {k[0] for k in plain_contamination(pairs(unique), items) if k[5]}
    assert Counter(pairs(clean)) == Counter(x for x in pairs(unique) if x[0] not in dirty)
    words = sum(n_words(t) for _, t in pairs(clean))
    assert abs(sum(n_words(t) for _, t in pairs(mixed)) - words) < 30
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = stage["tokens"](spark, mixed, sf)
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in last.collect())
    assert got == Counter((d, n, c) for d, _, n, c in plain_tokens(pairs(mixed), tokenizer))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()) == got


def test_stages_take_odd_rows_and_none(spark, odd, none, tiny, tmp_path):
    sf = "/root/testdata/sf0.001"
    mixed = odd.withColumn("doc_id", F.col("doc_id") + 100000).unionByName(tiny, allowMissingColumns=True)
    for name, df in (("odd", mixed), ("none", none)):
        docs = df
        for stage, run in corpus_pipeline.STAGES[:-1]:
            out = run(spark, docs, sf)
            assert out.schema == df.schema
            out.write.parquet(str(tmp_path / name / stage))
            docs = spark.read.schema(df.schema).parquet(str(tmp_path / name / stage))
        kept = docs.count()
        assert (kept > 100) == (name == "odd")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == kept
