"""Rank fusion, candidate unions and reranking over (q_id, key, rank, score) relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import rank

RRF_K, DEPTH = 60, 50


def candidate_union(a: DataFrame, b: DataFrame, qkey: str = "q_id", key: str = "doc_id") -> DataFrame:
    """Distinct candidates of two rankings with both ranks and scores and the fused score; a ranking's first position of a key counts."""
    first = lambda d, s: d.groupBy(qkey, key).agg(F.min("rank").alias(f"rank_{s}"), F.max("score").alias(f"score_{s}"))
    both = first(a, "a").join(first(b, "b"), [qkey, key], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    return both.withColumn("rrf", F.round(part("rank_a") + part("rank_b"), 9))


def rrf(a: DataFrame, b: DataFrame, k: int = DEPTH, qkey: str = "q_id", key: str = "doc_id") -> DataFrame:
    return rank(candidate_union(a, b, qkey, key).withColumnRenamed("rrf", "score"), [qkey], k, key=key)


def overlap(union: DataFrame, qkey: str = "q_id") -> DataFrame:
    """Set algebra of the two rankings for each query."""
    a, b = F.col("rank_a").isNotNull(), F.col("rank_b").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    out = union.groupBy(qkey).agg(F.count("*").alias("n_union"), n(a & b).alias("n_both"), n(a & ~b).alias("n_only_a"), n(b & ~a).alias("n_only_b"))
    return out.withColumn("overlap_pct", F.round(100.0 * F.col("n_both") / F.col("n_union"), 6))


def rerank(candidates: DataFrame, scorer: Callable[[DataFrame], Column], k: int, qkey: str = "q_id", key: str = "doc_id") -> DataFrame:
    """Candidates ranked anew by an injected score."""
    return rank(candidates.withColumn("score", F.round(scorer(candidates), 6)), [qkey], k, key=key)


def rank_defects(ranked: DataFrame, depth: int, qkey: str = "q_id", key: str = "doc_id") -> DataFrame:
    """Queries whose ranks aren't 1..n, whose keys repeat, or that are deeper than depth."""
    out = ranked.groupBy(qkey).agg(F.count("*").alias("n"), F.min("rank").cast("long").alias("low"), F.max("rank").cast("long").alias("high"), F.countDistinct("rank").alias("ranks"), F.countDistinct(key).alias("keys"))
    return out.withColumn("ok", (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("ranks") == F.col("n")) & (F.col("keys") == F.col("n")) & (F.col("n") <= depth))


def merged_metadata(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of both sides; a field that both have and that differs is a conflict, reported instead of a value."""
    j = a.alias("a").join(b.alias("b"), key, "full_outer")
    cols = [F.col(key)]
    clash = [F.when(F.col(f"a.{f}").isNotNull() & F.col(f"b.{f}").isNotNull() & (F.col(f"a.{f}") != F.col(f"b.{f}")), F.lit(f)) for f in fields]
    cols += [F.coalesce(F.col(f"a.{f}"), F.col(f"b.{f}")).alias(f) for f in fields]
    return j.select(*cols, F.filter(F.array(*clash), lambda x: x.isNotNull()).alias("conflicts"))


def pair_defects(a: DataFrame, b: DataFrame, qkey: str = "q_id", text: str = "query", identity: str = "corpus_fingerprint") -> DataFrame:
    """(q_id, defect): queries that only one of two runs has, whose text differs, or that ran over another corpus."""
    x, y = (d.select(qkey, F.col(text).alias(f"t{n}"), F.col(identity).alias(f"i{n}"), F.lit(True).alias(f"h{n}")).distinct() for n, d in (("a", a), ("b", b)))
    j = x.join(y, qkey, "full_outer")
    found = F.array(
        F.when(F.col("ha").isNull() | F.col("hb").isNull(), "one_side"), F.when(F.col("ha") & F.col("hb") & ~F.col("ta").eqNullSafe(F.col("tb")), "query"),
        F.when(F.col("ha") & F.col("hb") & ~F.col("ia").eqNullSafe(F.col("ib")), "corpus"),
    )
    return j.select(qkey, F.explode(F.array_compact(found)).alias("defect"))


def with_audit_ranks(union: DataFrame, audit: DataFrame, qkey: str = "q_id", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(union with the rank that another ranking gave as audit_rank, null where it has none; rows of that ranking that the union lacks, which is an error)."""
    ranks = audit.groupBy(qkey, key).agg(F.min("rank").alias("audit_rank"))
    return union.join(ranks, [qkey, key], "left"), ranks.join(union.select(qkey, key), [qkey, key], "left_anti")


def score_defects(candidates: DataFrame, scores: DataFrame, qkey: str = "q_id", key: str = "doc_id") -> DataFrame:
    """(q_id, key, defect): candidates without a score, scores without a candidate, pairs scored twice, scores that aren't numbers."""
    n = scores.groupBy(qkey, key).agg(F.count("*").alias("n"), F.max(F.col("score").isNull() | F.isnan("score")).alias("bad"))
    j = candidates.select(qkey, key, F.lit(True).alias("c")).distinct().join(n, [qkey, key], "full_outer")
    found = F.when(F.col("n").isNull(), "no_score").when(F.col("c").isNull(), "no_candidate").when(F.col("n") > 1, "scored_twice").when(F.col("bad"), "not_a_number")
    return j.withColumn("defect", found).filter("defect IS NOT NULL").select(qkey, key, "defect")


def length_summary(pairs: DataFrame, length: str, most: int) -> DataFrame:
    """One row: count, least, median and greatest length of scored pairs, and the share that a model of `most` tokens cuts."""
    cut = F.avg((F.col(length) > most).cast("double"))
    return pairs.agg(F.count("*").alias("n"), F.min(length).alias("low"), F.round(F.percentile(length, F.lit(0.5)), 6).alias("median"), F.max(length).alias("high"), F.round(cut, 9).alias("truncated_share"))


def hybrid(a: DataFrame, b: DataFrame, scorer: Callable[[DataFrame], Column], k: int = DEPTH, qkey: str = "q_id", key: str = "doc_id") -> dict[str, DataFrame]:
    """The rerank run over two rankings: candidates, their fused order, the reranked top k and the overlap of each query."""
    union = candidate_union(a, b, qkey, key)
    return {"candidates": union, "fused": rrf(a, b, k, qkey, key), "reranked": rerank(union, scorer, k, qkey, key), "overlap": overlap(union, qkey)}


def sentinel(ranked: DataFrame, qkey: str = "q_id", key: str = "doc_id") -> DataFrame:
    """(q_id, fingerprint) of each query's keys in order: a run that differs in one place differs here."""
    rows = ranked.groupBy(qkey).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("key")))).alias("r"))
    return rows.select(qkey, F.sha2(F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["rank"], x["key"])), ",").cast("binary"), 256).alias("fingerprint"))
