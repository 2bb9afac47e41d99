"""Importance resampling towards a target: hashed n-gram features, bucket gains, Gumbel top-k, all in Spark's own functions.

Words are taken in a text's A-Z lower case; features are all runs of 1 to `n` words, and a feature's bucket is its crc32 modulo `buckets`. Two bag-of-buckets models,
of all documents and of all target texts, give a gain for each bucket; a document's weight is the sum of its features' gains, and adding Gumbel noise to the weights
and taking the best is drawing without replacement in proportion to their exponentials (thousandths of nats here).

Texts are read into words once: their bucket numbers are written, exploded to count buckets, and exploded again to meet the broadcast gains (one row a bucket). Sums are
partial by row, so a document's features never meet in another task before they are one number, and texts don't move. Ranks come from a sort dealt by ranges: a row's
place in its partition plus the rows of the partitions before (a row for each partition).

Edge cases: a null text has no words; documents of fewer than `least` words get a score and no rank; ties go to the smaller doc_id, then to fewer features; a null
doc_id is hashed as an empty string and comes last among equals; rows that repeat a doc_id are drawn each for itself; no row is drawn from an empty table, and an empty
target has no features. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_text, parallelism, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def ngrams(w: Column, n: int) -> Column:
    """All runs of 1 to n consecutive words, joined by a space."""
    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (k - 1))
        return F.when(F.size(w) >= k, F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(w, *[runs(k) for k in range(2, n + 1)]) if n > 1 else w


def bucketed(docs: DataFrame, n: int, buckets: int, *keep: str) -> DataFrame:
    """Columns to keep, n_words, and the buckets of all features, repeats included."""
    w = docs.select(*keep, words(own_text()).alias("w"))
    return w.select(*keep, F.size("w").cast("long").alias("n_words"), F.transform(ngrams(F.col("w"), n), lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(buckets)).cast("int")).alias("b"))


def counted(rows: DataFrame) -> DataFrame:
    """(bucket, n)"""
    return rows.select(F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from (bucket, n) of corpus and target; thousandths of nats, rounded down."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    all_buckets = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    each = both.unionByName(all_buckets).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = Window.partitionBy(F.lit(0))  # `buckets` rows
    s, t, s_all, t_all = (c.cast("double") for c in (F.col("s"), F.col("t"), F.sum("s").over(every), F.sum("t").over(every)))
    return each.select("bucket", F.floor(F.lit(1000.0) * F.ln((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))).alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, percent: int, *order: Column) -> DataFrame:
    """Adds rank (1, 2, ... in the order; null beyond percent of the rows). A row's rank is its place in its range plus the rows of all ranges before."""
    n = parallelism(rows.sparkSession)
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = written(dealt.select("*", F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place")).drop("_id"), "importance-ranked")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each partition
    every = Window.partitionBy(F.lit(0)).orderBy("_range")
    before = sizes.select("_range", (F.sum("_n").over(every) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    rank = F.col("_before") + F.col("_place") + 1
    drawn = F.floor(F.col("_all") * percent / 100)
    return dealt.join(F.broadcast(before), "_range").withColumn("rank", F.when(rank <= drawn, rank)).drop("_range", "_place", "_before", "_all")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: percent of those with at least `least` words are drawn and have ranks."""
    rows = written(bucketed(docs.select("doc_id", "text"), n, buckets, "doc_id").withColumn("row", F.monotonically_increasing_id()), "importance-buckets")
    gain = gains(counted(rows), counted(bucketed(target.select("text"), n, buckets)), buckets)
    each = rows.select("row", "doc_id", "n_words", F.size("b").cast("long").alias("n_features"), F.explode_outer("b").alias("bucket")).join(F.broadcast(gain), "bucket", "left")
    weighed = each.groupBy("row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0).cast("long")).alias("weight"))
    scored = written(weighed.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")), "importance-scored")
    drawn = ranked(scored.filter(F.col("n_words") >= least), percent, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"))
    return drawn.unionByName(scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")


def op12(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark)


#: DuckDB: the same by lists; crc32 by its table of 256 remainders, over distinct words.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM benchmark),
dw AS (SELECT rid, unnest(w) AS word FROM d),
voc AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM b)),
wb AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::UBIGINT) AS u FROM voc),
bk AS (SELECT word, (xor(list_reduce(u, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000)::INT AS bucket FROM wb, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN bk USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN bk USING (word) GROUP BY bucket),
g AS (SELECT r.i::INT AS bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = r.i LEFT JOIN t ON t.bucket = r.i),
wt AS (SELECT rid, sum(gain)::BIGINT AS weight FROM dw JOIN bk USING (word) JOIN g USING (bucket) GROUP BY rid),
sc AS (SELECT rid, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN wt USING (rid)),
rk AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM sc LEFT JOIN rk USING (rid)
"""
