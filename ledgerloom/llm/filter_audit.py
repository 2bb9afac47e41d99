"""How filters of a corpus interact: masks of failures, their histogram, and all orders of the filters from the histogram alone.

Every document gets a five-bit mask of the filters that it fails (conditions() says which), by Spark's own functions in one scan. A filter that keeps the
first copy of a text takes the text's digest (SHA-256), grouped to its least doc_id by partial sums, so texts themselves don't move. Documents become 32 cells a part, and what
each of the 120 orders keeps, removes or loses in each step is a sum of cells; the 600 rows of a part come from its cells.

Two joins, of a digest and its least doc_id and of a doc_id and its label, move 60 bytes a document. A text that a third of all documents have makes one skewed key of the first, which
adaptive execution splits (spark.sql.adaptive.skewJoin, on by default); all other steps are partial aggregates.

Edge cases: a null text is an empty one; a null source is the part '', as an empty one is; a document without an id neither counts as an earlier copy nor has one; rows that repeat
doc_id and text are no copies of each other; labels that repeat a doc_id count once; documents without a label are neither good nor toxic; an empty table gives no rows; only the columns
named here are read, so others may have any name.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_text, written

LETTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def conditions(text: Column, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 2, marks: str = "#$%&*|") -> list[Column]:
    """Failures of A to D: too few words, too few distinct ones, too many capitals, any of the marks."""
    w = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")
    n, chars = F.size(w), F.length(text)
    return [
        n < min_words,
        100 * F.size(F.array_distinct(w)) < distinct_percent * n,
        100 * (chars - F.length(F.translate(text, UPPER, ""))) > upper_percent * chars,
        F.length(F.translate(text, marks, "")) < chars,
    ]


def masks(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, part, mask): bits of A to D as conditions() gives them, and E, that a smaller doc_id has the same text."""
    text = F.coalesce(own_text(), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("t"), **options))]
    rows = written(named.select("doc_id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask")), "audit-masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = written(first, "audit-first")  # adaptive execution splits a skewed text only where no aggregate stands between exchange and join
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(late, 16).otherwise(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): at most 32 of (mask, n, good, toxic)."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    each = masked.join(marked, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return each.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def _sum(where, what) -> Column:
    return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda acc, x: acc + what(x))


def orders(of_part: DataFrame, filters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the part's cells."""
    all_orders = F.split(F.lit(",".join(map("".join, permutations(filters)))), ",")
    rows = of_part.select("part", "cells", F.explode(all_orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bits = lambda s: sum((F.when(F.contains(s, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(filters)), F.lit(0))
    rows = rows.withColumn("before", bits(F.expr("substring(filter_order, 1, step - 1)"))).withColumn("bit", bits(F.expr("substring(filter_order, step, 1)")))
    fails = lambda x: x["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda x: x["mask"].bitwiseAND(F.col("before")) != 0
    n, total = (lambda x: x["n"]), len(list(permutations(filters)))
    out = {
        "kept": _sum(lambda x: ~gone(x) & ~fails(x), n),
        "removed": _sum(lambda x: ~gone(x) & fails(x), n),
        "redundant": _sum(lambda x: gone(x) & fails(x), n),
        "unique_fails": _sum(lambda x: x["mask"] == F.col("bit"), n),
        "good_lost": _sum(lambda x: ~gone(x) & fails(x), lambda x: x["good"]),
        "toxic_lost": _sum(lambda x: ~gone(x) & fails(x), lambda x: x["toxic"]),
        # Each of the filters that a document fails comes first among them in an equal share of all orders.
        "shapley": _sum(fails, lambda x: x["n"] * (F.lit(total) / F.bit_count(x["mask"])).cast("long")),
    }
    return rows.select("part", "filter_order", F.col("step").cast("int").alias("step"), *[c.alias(k) for k, c in out.items()])


def op13(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return orders(cells(masks(docs), labels))


#: DuckDB: masks document by document, every order from them.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT rid, doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(l.good), 0) AS good, coalesce(sum(l.toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, step::INT AS step, list_sum(list_transform(string_split(filter_order, '')[1:step - 1], lambda x: 1 << (ascii(x) - 65)))::INT AS before, (1 << (ascii(filter_order[step:step]) - 65))::INT AS bit
  FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
x AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & coalesce(before, 0) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM x
"""
