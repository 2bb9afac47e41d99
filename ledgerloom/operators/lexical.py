"""Exact BM25 over an inverted index, written once and searched often.

Postings lie in blocks: documents fall into blocks by a hash of their keys, and a term's postings within a block are one row with the greatest part that any of them can add
to a score. A search first adds up these parts by query and block, without reading a posting; scores the most promising blocks of each query; and reads of the
others only those that could still hold one of the k best. A block that is skipped can't, so ranks are those of a full search.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lexical
from ..sources.canonical import canonical_json, sha256
from ..sources.written import discard, shared_folder
from .stored import kept

K1, B = 1.5, 0.75
#: Folders of postings, by a hash of the term: a search reads those of its terms.
BUCKETS = 32
#: Terms of queries up to which they are sent as literals, so the scan prunes folders and row groups by them.
SENT_TERMS = 2000
#: Terms of all queries together up to which they are broadcast (some 10 MB), so that postings aren't dealt by term.
SENT_ROWS = 200_000
#: Documents that a block has about; blocks of each query that are scored first.
BLOCK, FIRST = 64, 4
#: Blocks to a task that builds the index, about: each writes a file to every folder.
LEAST_A_TASK, MOST_A_TASK = 32, 256


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text", of=lexical) -> DataFrame:
    """(key, tokens): an empty array for an empty text."""
    return docs.select(key, of(F.col(text)).alias("tokens"))


def postings(tokens: DataFrame, key: str = "doc_id", *also: str) -> DataFrame:
    """(key, also, term, dl, tf): exploded and counted before any shuffle, and without one if tokens are dealt by some of `key` and `also`; dl rides along."""
    terms = tokens.select(key, *also, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return terms.groupBy(key, *also, "term", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n, avgdl, min_dl, max_dl over all documents, empty ones too."""
    dl = F.size("tokens")
    return tokens.agg(F.count("*").alias("n"), F.avg(dl).alias("avgdl"), F.min(dl).cast("long").alias("min_dl"), F.max(dl).cast("long").alias("max_dl"))


def rank(scored: DataFrame, by: list[str], k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """Top k by (-score, key), ranks from 1; Spark cuts to k in each partition before it shuffles."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@dataclass
class Index:
    """Written tables: postings (key, term, tf, dl) in folders by term, sorted by it; terms (term, df, cf); one row of corpus statistics."""

    spark: SparkSession
    path: str
    key: str
    k1: float = K1
    b: float = B

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, of=lexical, block: int = BLOCK) -> "Index":
        """Texts are tokenised once, in a map; documents, not postings, are dealt, by block, so that all that follows is within tasks and a frequent term's rows are
        spread over them. Tokens are removed once the blocks are written."""
        if k1 < 0 or not 0 <= b <= 1:
            raise ValueError("k1 must not be negative, b lies between 0 and 1")
        spark = docs.sparkSession
        out = cls(spark, path or f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}", key, k1, b)
        tokenised(docs, key, text, of).write.parquet(f"{out.path}/tokens")
        tokens = spark.read.parquet(f"{out.path}/tokens")
        corpus_stats(tokens).coalesce(1).write.parquet(f"{out.path}/stats")
        s = out.stats().first()
        blocks = max(1, -(-s.n // block))
        parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // LEAST_A_TASK)), -(-blocks // MOST_A_TASK))
        dealt = tokens.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks))).repartition(parts, "block")
        part = out._part(F.col("tf"), F.col("dl"), F.lit(s.avgdl))
        rows = postings(dealt, key, "block").groupBy("term", "block").agg(F.max(part).alias("best"), F.collect_list(F.struct(key, "tf", "dl")).alias("docs"))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{out.path}/blocks")
        discard(spark, f"{out.path}/tokens")
        sums = out.blocks().select("term", F.size("docs").alias("df"), F.aggregate("docs", F.lit(0).cast("long"), lambda acc, x: acc + x["tf"]).alias("cf"))
        sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).sort("term").write.parquet(f"{out.path}/terms")
        return out

    def _part(self, tf: Column, dl: Column, avgdl: Column) -> Column:
        """What a posting adds to a score, but for the term's weight."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / avgdl))

    def drop(self) -> None:
        discard(self.spark, self.path)

    def blocks(self) -> DataFrame:
        """(term, block, best, docs, bucket)"""
        return self.spark.read.parquet(f"{self.path}/blocks")

    def postings(self) -> DataFrame:
        """(term, key, tf, dl)"""
        return self.blocks().select("term", F.explode("docs").alias("x")).select("term", "x.*")

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/stats")

    def statistics(self) -> DataFrame:
        """One row: n, avgdl, min_dl, max_dl, vocabulary, postings."""
        return self.stats().crossJoin(self.terms().agg(F.count("*").alias("vocabulary"), F.sum("df").alias("postings")))

    def config(self) -> dict:
        """Fixed values of the tokenizer and the parameters."""
        return {
            "tokenizer": {"version": "sec_lexical_v1", "unicode_normalization": "NFKC", "case_normalization": "casefold", "grouping_commas": "removed_within_numeric_tokens", "stemming": False, "stop_words": False},
            "k1": self.k1, "b": self.b,
        }

    def fingerprint(self) -> str:
        """Of the configuration and of every posting, whatever their order."""
        rows = self.postings().agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(self.key, "term", "tf", "dl", F.lit(k)).cast("decimal(38,0)")).cast("string").alias(f"h{k}") for k in (0, 1)]).first()
        return sha256(canonical_json(self.config() | rows.asDict()))

    def _asked(self, queries: DataFrame, qkey: str, qtext: str, of) -> tuple[DataFrame, DataFrame]:
        """((q_id, term, idf, avgdl) of the queries' distinct terms, blocks of these terms)."""
        q = queries.select(qkey, F.explode(F.array_distinct(of(F.col(qtext)))).alias("term"))
        used = [r.term for r in q.select("term").distinct().limit(SENT_TERMS + 1).collect()]
        hits, df = self.blocks(), self.terms()
        if len(used) <= SENT_TERMS:
            folders = [r[0] for r in self.spark.createDataFrame([(t,) for t in used], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
            hits, df = hits.filter(F.col("bucket").isin(folders) & F.col("term").isin(used)), df.filter(F.col("term").isin(used))
        s = self.stats().first()
        weights = df.select("term", F.log1p((F.lit(s.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.lit(s.avgdl).alias("avgdl"))
        asked = q.join(weights, "term")
        return F.broadcast(asked) if q.limit(SENT_ROWS + 1).count() <= SENT_ROWS else asked, hits

    def _scored(self, asked: DataFrame, hits: DataFrame, qkey: str, of_blocks: DataFrame | None = None) -> DataFrame:
        """(q_id, key, score) of the documents of all blocks, or of those listed (q_id, block)."""
        j = hits
        if of_blocks is not None:  # by block alone, so a document's postings come together and its score needs no other shuffle
            j = j.join(of_blocks.groupBy("block").agg(F.collect_set(qkey).alias("_of")).hint("merge"), "block")
        j = j.join(asked, "term")
        if of_blocks is not None:
            j = j.filter(F.array_contains("_of", F.col(qkey)))
        each = j.select(qkey, "block", "idf", "avgdl", F.explode("docs").alias("x")).select(qkey, "block", "idf", "avgdl", "x.*")
        scores = each.groupBy(qkey, "block", self.key).agg(F.round(F.sum(F.col("idf") * self._part(F.col("tf"), F.col("dl"), F.col("avgdl"))), 6).alias("score"))
        return scores.select(qkey, self.key, "score")

    def score(self, queries: DataFrame, qkey: str = "q_id", qtext: str = "query", of=lexical) -> DataFrame:
        """(q_id, key, score) of every document that shares a term with the query, rounded to six places, so the order of summation doesn't show."""
        return self._scored(*self._asked(queries, qkey, qtext, of), qkey)

    def bounds(self, queries: DataFrame, qkey: str = "q_id", qtext: str = "query", of=lexical) -> DataFrame:
        """(q_id, block, bound): no document of the block has a greater score."""
        asked, hits = self._asked(queries, qkey, qtext, of)
        return hits.select("term", "block", "best").join(asked, "term").groupBy(qkey, "block").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"))

    def search(self, queries: DataFrame, k: int = 10, where: DataFrame | None = None, qkey: str = "q_id", qtext: str = "query") -> DataFrame:
        """(q_id, key, score, rank) of the k best. `where` holds the keys of admitted documents; n, df and avgdl stay those of the whole corpus."""
        return self.searched(queries, k, where, qkey, qtext)[0]

    def searched(self, queries: DataFrame, k: int = 10, where: DataFrame | None = None, qkey: str = "q_id", qtext: str = "query", of=lexical) -> tuple[DataFrame, DataFrame]:
        """(search(), blocks (q_id, block, bound, first, read): those scored first, and those read at all)."""
        asked, hits = self._asked(queries, qkey, qtext, of)
        bounds = hits.select("term", "block", "best").join(asked, "term").groupBy(qkey, "block").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"))
        order = Window.partitionBy(qkey).orderBy(F.desc("bound"), "block")
        bounds = bounds.withColumn("first", F.row_number().over(order) <= FIRST)

        def admitted(scored: DataFrame) -> DataFrame:
            return scored if where is None else scored.join(where.select(self.key), self.key, "left_semi")

        early = admitted(self._scored(asked, hits, qkey, bounds.filter("first")))
        floor = rank(early, [qkey], k, key=self.key).filter(F.col("rank") == k).select(qkey, F.col("score").alias("floor"))
        # Scores and bounds are sums in different orders, and scores are rounded.
        open_ = F.col("floor").isNull() | (F.col("bound") * (1 + 1e-9) + 1e-6 >= F.col("floor"))
        blocks = bounds.join(floor, qkey, "left").select(qkey, "block", "bound", "first", (F.col("first") | open_).alias("read"))
        late = admitted(self._scored(asked, hits, qkey, blocks.filter("read AND NOT first")))
        return rank(early.unionByName(late), [qkey], k, key=self.key), blocks

    def run(self, queries: DataFrame, k: int = 50, qkey: str = "q_id", qtext: str = "query") -> DataFrame:
        """The batch of all queries: one row for each, its text, how many results it has and the results in order; queries without any are there, empty."""
        got = self.search(queries, k, None, qkey, qtext).groupBy(qkey).agg(F.array_sort(F.collect_list(F.struct("rank", "score", self.key))).alias("ranked_results"))
        none = F.array().cast(f"array<struct<rank:int,score:double,{self.key}:{self.blocks().schema["docs"].dataType.elementType[self.key].dataType.simpleString()}>>")
        out = queries.select(qkey, qtext).join(got, qkey, "left").withColumn("ranked_results", F.coalesce("ranked_results", none))
        return out.withColumn("n_results", F.size("ranked_results"))


def index_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The application's index of a table of files; the texts are hashed in every call, and other texts are another index."""
    return kept(docs, "bm25", (key, text), lambda: Index.build(docs, key=key, text=text))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, key: str = "doc_id", text: str = "text", qkey: str = "q_id", qtext: str = "query") -> DataFrame:
    """(q_id, key, score, rank) over an index built for this call; `where` restricts the candidates."""
    return Index.build(docs, key=key, text=text).search(queries, k, None if where is None else docs.filter(where), qkey, qtext)


def top_terms(index: Index, k: int) -> DataFrame:
    return index.terms().orderBy(F.desc("df"), F.asc("term")).limit(k)
