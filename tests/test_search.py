"""Block-max BM25, the vector blocks and kept indexes against plain versions."""

import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dense, lexical, stored
from tests.conftest import SF_TINY

# --- BM25


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choice(words[: r.choice((5, 40, 400))]) for _ in range(r.randint(0, 60)))) for i in range(600)] + [(1000, None), (1001, "w1")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w1 w350 w351"), (2, "w0 w1 w2 w3 w4"), (3, "w399"), (4, "nothing here"), (5, ""), (6, "w377 w377 w17")], "q_id long, query string")


def test_blocks_are_skipped_and_ranks_stay(spark, texts, queries):
    index = lexical.Index.build(texts, block=8)
    full = {tuple(r) for r in lexical.rank(index.score(queries), ["q_id"], 2).select("q_id", "doc_id", "score", "rank").collect()}
    got, blocks = index.searched(queries, 2)
    assert {tuple(r) for r in got.select("q_id", "doc_id", "score", "rank").collect()} == full
    n = {r.q_id: (r.n, r.read, r.first) for r in blocks.groupBy("q_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("read"), 1)).alias("read"), F.count(F.when(F.col("first"), 1)).alias("first")).collect()}
    assert set(n) == {1, 2, 3, 6} and all(first <= read <= total for total, read, first in n.values())
    assert n[1][1] < n[1][0] / 2 and n[6][1] < n[6][0] / 2  # a rare term lifts the bar over what common ones can add
    bound = {(r.q_id, r.block): r.bound for r in index.bounds(queries).collect()}
    where = {r.doc_id: r.b for r in texts.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(math.ceil(602 / 8))).alias("b")).collect()}
    assert all(r.score <= bound[r.q_id, where[r.doc_id]] + 1e-6 for r in index.score(queries).collect())
    index.drop()


def test_filters_lower_the_bar(spark, texts, queries):
    index = lexical.Index.build(texts, block=8)
    some = texts.filter("doc_id % 3 = 1").select("doc_id")
    full = lexical.rank(index.score(queries).join(some, "doc_id", "left_semi"), ["q_id"], 5).select("q_id", "doc_id", "score", "rank")
    got = index.search(queries, 5, some).select("q_id", "doc_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
    index.drop()


def test_many_terms_are_joined(spark, texts, queries, monkeypatch):
    index = lexical.Index.build(texts)
    rows = lambda: sorted(map(tuple, index.search(queries, 5).select("q_id", "doc_id", "score", "rank").collect()))
    few = rows()
    monkeypatch.setattr(lexical, "SENT_TERMS", 2)
    assert rows() == few
    index.drop()


def test_other_texts_under_the_same_path(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    put = lambda n: spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word number "), F.col("id").cast("string")).alias("text")).coalesce(1).write.mode("overwrite").parquet(path)
    put(2)
    first = lexical.index_of(spark.read.parquet(path))
    assert first.statistics().first().n == 2 and lexical.index_of(spark.read.parquet(path)) is first
    put(9)
    assert lexical.index_of(spark.read.parquet(path)).statistics().first().n == 9
    at = spark._jvm.org.apache.hadoop.fs.Path(first.path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


# --- vectors


def plain_top(vectors, queries, k):
    out = []
    unit = {i: np.array(v, float) for i, v in vectors if v is not None}
    for q, w in queries:
        w = np.array(w, float)
        scored = []
        for i, v in unit.items():
            a, b = math.sqrt(v @ v), math.sqrt(w @ w)
            if a > 0 and b > 0 and math.isfinite(a):
                scored.append((math.copysign(math.floor(abs(v @ w / (a * b)) * 1e6 + 0.5) / 1e6, v @ w) + 0.0, i))
        out += [(q, i, s, n + 1) for n, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(500, [0.0] * 6), (501, [math.nan] + [1.0] * 5), (502, None), (503, [math.inf] * 6)]
    return rows


@pytest.mark.parametrize("rows, scores, asked", [(4096, 1 << 22, 16_384), (7, 50, 3)])
def test_blocks_of_any_size(spark, vectors, monkeypatch, rows, scores, asked):
    for name, value in (("ROWS", rows), ("SCORES", scores), ("QUERY_BLOCK", asked)):
        monkeypatch.setattr(dense, name, value)
    queries = [(i, v) for i, v in vectors if i % 50 == 7 and i < 300] + [(900, [0.0] * 6), (901, vectors[7][1])]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "q_id long, q_embedding array<double>")
    got = dense.cosine(v, q, 12).select("q_id", "vec_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == plain_top(vectors, queries, 12)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_text_keys_and_ties(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("é", [3.0, 0.0]), ("c", [0.0, 1.0])], "vec_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "q_id string, q_embedding array<float>")
    assert [(r.vec_id, r["rank"]) for r in dense.cosine(v, q, 3).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("é", 3)]
    assert [r.vec_id for r in dense.by_dot(v, q, 2).orderBy("rank").collect()] == ["é", "a"]


def test_index_knows_its_vectors(spark, vectors):
    v = spark.createDataFrame([(i, x, i % 3) for i, x in vectors], "vec_id long, embedding array<double>, label int")
    q = v.filter("vec_id = 7").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    index = dense.VectorIndex.build(v, keep=("label",), dimension=6)
    again = dense.VectorIndex.open(index.path, v, keep=("label",))
    got = again.search(q, 5, where=lambda r: r["label"] == 2).select("vec_id", "score").collect()
    assert got == dense.cosine(v, q, 5, F.col("label") == 2).select("vec_id", "score").collect() and len(got) == 5
    assert [(r.q_id, r.n_results, len(r.ranked_results)) for r in index.run(q.unionByName(q.select((-F.col("q_id")).alias("q_id"), F.lit(None).cast("array<double>").alias("q_embedding"))), 4).orderBy("q_id").collect()] == [(-7, 0, 0), (7, 4, 4)]
    with pytest.raises(dense.WrongIndex, match="ids_hash"):
        dense.VectorIndex.open(index.path, v.filter("vec_id <> 3"))
    with pytest.raises(dense.WrongIndex, match="dimensions"):
        dense.VectorIndex.build(v, dimension=7)
    with pytest.raises(Exception, match="dimensions"):
        dense.cosine(v, spark.createDataFrame([(1, [1.0])], "q_id long, q_embedding array<double>")).collect()
    index.drop()


def test_kept_indexes_go(spark):
    v = spark.read.parquet(f"{SF_TINY}/embeddings.parquet")
    index = stored.kept(v, "vectors", ("vec_id", "embedding"), lambda: dense.VectorIndex.build(v))
    assert stored.kept(v, "vectors", ("vec_id", "embedding"), lambda: 1 / 0) is index
    stored.forget()
    assert stored.kept(v, "vectors", ("vec_id", "embedding"), lambda: dense.VectorIndex.build(v)) is not index


def test_scores_are_summed_where_blocks_lie(spark):
    """A search deals postings by block once, never by query; the tokens of the build are gone."""
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 3} and more") for i in range(400)], "doc_id long, text string")
    index = lexical.Index.build(docs, block=8)
    assert "tokens" not in {p.name for p in Path(index.path.removeprefix("file://")).iterdir()}
    got = index.search(spark.createDataFrame([(1, "word1 more"), (2, "word2")], "q_id long, query string"), 3)
    assert not re.search(r"hashpartitioning\(q_id#\d+L?, (block#\d+L?, )?doc_id", got._jdf.queryExecution().executedPlan().toString())
    assert got.count() == 6
