"""Evaluation of rankings (system, q_id, rank, key) against AND/OR gold (q_id, item_id, part_id, importance, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS, MISS_KS, DEPTH = (1, 3, 5, 10, 20, 50), (10, 50), 50
#: Fixed values.
WEIGHTS = {"core": 3.0, "supporting": 1.5, "optional": 0.5}


def first_ranks(rankings: DataFrame, gold: DataFrame, key: str = "key") -> DataFrame:
    """(system, q_id, item_id, part_id, importance, first_rank): the least rank among a part's alternatives; null if none is ranked."""
    systems = rankings.select("system").distinct()
    parts = gold.select("q_id", "item_id", "part_id", "importance").distinct().crossJoin(F.broadcast(systems))
    hits = gold.join(rankings, ["q_id", key]).groupBy("system", "q_id", "item_id", "part_id").agg(F.min("rank").cast("long").alias("first_rank"))
    return parts.join(hits, ["system", "q_id", "item_id", "part_id"], "left")


def _ks(ks):
    return F.explode(F.array(*[F.lit(k).cast("long") for k in ks])).alias("k")


def item_hits(first: DataFrame, ks=KS) -> DataFrame:
    """(system, q_id, item_id, importance, k, parts, hits, coverage, all_parts): all parts of an item must be hit, any alternative of a part will do."""
    rows = first.select("*", _ks(ks))
    out = rows.groupBy("system", "q_id", "item_id", "importance", "k").agg(F.count("*").alias("parts"), F.count(F.when(F.col("first_rank") <= F.col("k"), 1)).alias("hits"))
    return out.withColumn("coverage", F.col("hits") / F.col("parts")).withColumn("all_parts", F.col("hits") == F.col("parts"))


def weight():
    out = F.lit(None).cast("double")
    for name, w in WEIGHTS.items():
        out = F.when(F.col("importance") == name, F.lit(w)).otherwise(out)
    return out


def panel(items: DataFrame, by: list[str]) -> DataFrame:
    """The metric panel for each group of `by`."""
    w, full = weight(), F.col("all_parts").cast("double")
    core = F.col("importance") == "core"
    share = lambda a, b: F.round(F.try_divide(a, b), 9)
    return items.groupBy(*by).agg(
        F.count("*").alias("n_items"), F.sum("parts").alias("n_parts"), share(F.sum("hits"), F.sum("parts")).alias("part_recall"), F.round(F.avg("coverage"), 9).alias("item_coverage"),
        F.round(F.avg(full), 9).alias("all_parts_rate"), share(F.sum(w * full), F.sum(w)).alias("weighted_strict"), share(F.sum(w * F.col("coverage")), F.sum(w)).alias("weighted_partial"),
        share(F.sum(F.when(core, F.col("hits"))), F.sum(F.when(core, F.col("parts")))).alias("core_recall"), F.count(F.when(F.col("hits") == 0, 1)).alias("zero_hit_items"),
    )


def evidence_metrics(first: DataFrame) -> DataFrame:
    return panel(item_hits(first), ["system", "k"])


def per_question(first: DataFrame, ks=KS) -> DataFrame:
    """Panels for each question and, with q_id null, overall."""
    items = item_hits(first, ks)
    one = panel(items, ["system", "k", "q_id"])
    return one.unionByName(panel(items, ["system", "k"]).withColumn("q_id", F.lit(None).cast(items.schema["q_id"].dataType)).select(one.columns))


def mrr(first: DataFrame, depth: int = DEPTH) -> DataFrame:
    r = F.when(F.col("first_rank") <= depth, 1.0 / F.col("first_rank")).otherwise(0.0)
    return first.groupBy("system").agg(F.count("*").alias("n_parts"), F.round(F.sum(r) / F.count("*"), 9).alias("part_mrr"))


def first_hit_histogram(first: DataFrame) -> DataFrame:
    edge = F.when(F.col("first_rank").isNull(), "none").when(F.col("first_rank") == 1, "1").when(F.col("first_rank") <= 3, "2-3").when(F.col("first_rank") <= 10, "4-10").when(F.col("first_rank") <= 50, "11-50").otherwise("beyond")
    return first.groupBy("system", edge.alias("bucket")).agg(F.count("*").alias("n"))


def misses(first: DataFrame, ks=MISS_KS) -> DataFrame:
    """Items with missing parts at k and why: labels add up; the fallback stands alone."""
    rows = first.select("*", _ks(ks))
    g = rows.groupBy("system", "q_id", "item_id", "k").agg(
        F.count("*").alias("parts"), F.count(F.when(F.col("first_rank") <= F.col("k"), 1)).alias("hits"),
        F.min(F.when(F.col("first_rank") > F.col("k"), F.col("first_rank"))).alias("first_below"),
    )
    g = g.filter("hits < parts")
    partial = F.when((F.col("hits") > 0) & (F.col("parts") > 1), F.lit("partial_hit"))
    below = F.when(F.col("first_below").isNotNull() & (F.col("first_below") <= DEPTH), F.lit("below_k"))
    found = F.array_compact(F.array(partial, below))
    return g.withColumn("labels", F.when(F.size(found) > 0, F.array_join(found, ";")).otherwise("not_retrieved"))


def failure_counts(missed: DataFrame) -> DataFrame:
    return missed.select("system", "k", F.explode(F.split("labels", ";")).alias("label")).groupBy("system", "k", "label").agg(F.count("*").alias("n"))


def long_metrics(metrics: DataFrame, names: list[str], by: tuple = ("k",)) -> DataFrame:
    """(system, by, metric, value)."""
    each = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select("system", *by, F.explode(each).alias("m")).select("system", *by, "m.metric", "m.value")


def comparison(metrics: DataFrame, a: str, b: str, names: list[str]) -> DataFrame:
    """Long metrics of two systems side by side with the absolute difference."""
    both = compared(metrics, [a, b], names)
    return both.select("k", "metric", F.col(a).alias("value_a"), F.col(b).alias("value_b"), F.round(F.abs(F.col(a) - F.col(b)), 9).alias("difference"))


def compared(metrics: DataFrame, systems: list[str], names: list[str], by: tuple = ("k",)) -> DataFrame:
    """Long metrics of any number of systems side by side, a column for each, and for each pair the later one's gain over the earlier one, signed, as
    <later>_minus_<earlier>."""
    long = long_metrics(metrics.filter(F.col("system").isin(systems)), names, by)
    out = long.groupBy(*by, "metric").pivot("system", systems).agg(F.first("value"))
    return out.withColumns({f"{y}_minus_{x}": F.round(F.col(y) - F.col(x), 9) for i, x in enumerate(systems) for y in systems[i + 1 :]})


def numeric_metrics(first: DataFrame, group: Column, ks=KS) -> DataFrame:
    """Facts are items, all of whose parts must be hit; `group` names the answer that an item is a variant of: any variant will do; a question needs all its
    groups. Facts of several parts (inputs) also count by themselves: the share hit in full, and the mean share of inputs hit; null where there are none."""
    items = item_hits(first, ks)
    many = F.col("parts") > 1
    facts = items.groupBy("system", "k").agg(
        F.round(F.avg(F.col("all_parts").cast("double")), 9).alias("strict_fact_coverage"), F.round(F.avg(F.when(many, F.col("all_parts").cast("double"))), 9).alias("multi_input_strict_rate"),
        F.round(F.avg(F.when(many, F.col("coverage"))), 9).alias("mean_input_coverage"),
    )
    groups = items.groupBy("system", "k", "q_id", group.alias("group_id")).agg(F.max(F.col("all_parts").cast("int")).alias("any_variant"))
    b = groups.groupBy("system", "k").agg(F.round(F.avg(F.col("any_variant").cast("double")), 9).alias("group_coverage"))
    questions = groups.groupBy("system", "k", "q_id").agg(F.min("any_variant").alias("complete"))
    c = questions.groupBy("system", "k").agg(F.round(F.avg(F.col("complete").cast("double")), 9).alias("complete_question_rate"))
    return facts.join(b, ["system", "k"]).join(c, ["system", "k"])


def derived_ranks(first: DataFrame, inputs: DataFrame) -> DataFrame:
    """inputs (q_id, item_id, input_id): items that are derived take the parts of their inputs, as deep as graph.leaves() unfolded them, as parts of their own."""
    leaf = first.select("system", "q_id", F.col("item_id").alias("input_id"), F.col("part_id").alias("_p"), "first_rank")
    own = first.select("q_id", "item_id", "importance").distinct().join(inputs, ["q_id", "item_id"])
    part = F.concat_ws("/", F.col("input_id").cast("string"), F.col("_p").cast("string"))
    got = own.join(leaf, ["q_id", "input_id"]).select("system", "q_id", "item_id", part.alias("part_id"), "importance", "first_rank").distinct()
    plain = first.join(inputs.select("q_id", "item_id").distinct(), ["q_id", "item_id"], "left_anti")
    return plain.select("system", "q_id", "item_id", F.col("part_id").cast("string").alias("part_id"), "importance", "first_rank").unionByName(got)


def scored(rankings: DataFrame, gold: DataFrame, group: Column, depth: int = DEPTH) -> dict[str, DataFrame]:
    """All reports on rankings (system, q_id, rank, key) against gold, by name; rankings that aren't 1..n, repeat a key or go beyond depth stop it."""
    defects = rankings.groupBy("system", "q_id").agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("ranks"), F.countDistinct("key").alias("keys"))
    if bad := defects.filter(~((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("ranks") == F.col("n")) & (F.col("keys") == F.col("n")) & (F.col("n") <= depth))).head(3):
        raise ValueError(f"malformed rankings: {[(r.system, r.q_id) for r in bad]}")
    if rows := gold.groupBy("q_id", "item_id").agg(F.countDistinct("importance").alias("n")).filter("n > 1").head(3):
        raise ValueError(f"items of several classes: {[(r.q_id, r.item_id) for r in rows]}")
    first = first_ranks(rankings, gold)
    missed = misses(first)
    return {"evidence": evidence_metrics(first), "per_question": per_question(first), "numeric": numeric_metrics(first, group), "mrr": mrr(first), "histogram": first_hit_histogram(first), "misses": missed, "failures": failure_counts(missed)}


def ordered_distinct(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """First-seen order of distinct values in each group."""
    w = Window.partitionBy(*by, value).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
