"""Where a result stands in its document, and what surrounds a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import duration_months, unit_scale


def locator(explicit: str = "locator", path: str = "section_path", doc: str = "doc_id", start: str = "char_start", end: str = "char_end") -> Column:
    """An explicit locator, else the sections joined, else the document's characters; null where there is none of them."""
    named = F.when(F.size(path) > 0, F.array_join(F.col(path), " > "))
    chars = F.when(F.col(start).isNotNull() & F.col(end).isNotNull(), F.concat(F.col(doc).cast("string"), F.lit(" chars "), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string")))
    return F.coalesce(F.nullif(F.col(explicit), F.lit("")), named, chars)


def inherit_table_metadata(blocks: DataFrame, look_back: int = 4) -> DataFrame:
    """Tables without a scale or caption take them from up to four blocks before them in the same section: the nearest scale, the nearest short title."""
    w = Window.partitionBy("doc_id", "section").orderBy("position").rowsBetween(-look_back, -1)
    title = (F.col("block_type") == "heading") | (F.regexp_like("text", F.lit(r"^\p{Lu}[^\p{Ll}0-9]*$")) & (F.size(F.split("text", " ")) <= 16))
    out = blocks.withColumn("_s", F.last(F.when(F.col("block_type") != "table", unit_scale(F.col("text"))), ignorenulls=True).over(w))
    out = out.withColumn("_t", F.last(F.when((F.col("block_type") != "table") & title, F.col("text")), ignorenulls=True).over(w))
    table = F.col("block_type") == "table"
    out = out.withColumn("scale", F.when(table, F.coalesce("scale", "_s"))).withColumn("caption", F.when(table, F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.col("_t"))))
    return out.drop("_s", "_t")


def attach_footnotes(blocks: DataFrame) -> DataFrame:
    """Paragraphs right after a table, in its section, whose leading marker the table refers to become footnotes; the first other text ends them.
    Tables have `refs`, an array of markers."""
    w = Window.partitionBy("doc_id", "section").orderBy("position")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marker = F.regexp_extract(F.trim("text"), r"^[(\[]?([0-9]{1,2}|[a-z])[)\]]", 1)
    blank = F.regexp_like("text", F.lit(r"^[\s_*-]*$"))
    t = blocks.withColumn("_at", F.last(F.when(F.col("block_type") == "table", F.col("position")), ignorenulls=True).over(upto)).withColumn("_refs", F.last(F.when(F.col("block_type") == "table", F.col("refs")), ignorenulls=True).over(upto))
    note = (F.col("block_type") == "paragraph") & F.array_contains("_refs", marker)
    stops = (F.col("block_type") != "table") & ~blank & ~F.coalesce(note, F.lit(False))
    after = Window.partitionBy("doc_id", "section", "_at").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_stopped", F.sum(stops.cast("int")).over(after))
    is_note = F.col("_at").isNotNull() & F.coalesce(note, F.lit(False)) & (F.col("_stopped") == 0)
    t = t.withColumn("_note", is_note).withColumn("block_type", F.when(F.col("_note"), "footnote").otherwise(F.col("block_type")))
    return t.withColumn("table_position", F.when(F.col("_note"), F.col("_at"))).drop("_at", "_refs", "_stopped", "_note")


def start_from_contexts(cells: DataFrame, contexts: DataFrame) -> DataFrame:
    """A cell's duration in months up to its end gets the start of the context with that end and length; of several, that with the fewest dimensions, then the
    least id."""
    c = contexts.filter("period_start IS NOT NULL").withColumn("months", duration_months(F.col("period_start"), F.col("period_end")))
    best = c.groupBy("doc_id", "period_end", "months").agg(F.min(F.struct(F.col("n_dimensions"), F.col("context_id"), F.col("period_start"))).alias("b"))
    out = cells.join(best, ["doc_id", "period_end", "months"], "left")
    found = F.col("period_start").isNull() & F.col("b").isNotNull()
    return out.withColumn("period_source", F.when(found, F.col("b.context_id"))).withColumn("period_start", F.coalesce("period_start", F.col("b.period_start"))).drop("b")


def reconcile_periods(cells: DataFrame, links: DataFrame) -> DataFrame:
    """links (cell_id, period): facts in a cell with one period that isn't the header's win; several leave the header and mark it ambiguous."""
    g = links.filter("period IS NOT NULL").groupBy("cell_id").agg(F.countDistinct("period").alias("n"), F.min("period").alias("p"))
    j = cells.join(g, "cell_id", "left")
    state = F.when(F.col("n").isNull(), "header").when(F.col("n") > 1, "direct_ambiguous").when(F.col("p").eqNullSafe(F.col("period")), "agrees").otherwise("direct_fact")
    return j.select("cell_id", F.when(state == "direct_fact", F.col("p")).otherwise(F.col("period")).alias("period"), state.alias("reconciliation"))


def match_by_value(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """cells (cell_id, doc_id, magnitude, period_end): the one context of facts with that magnitude, and that end where it is known; several are refused."""
    j = cells.join(facts.select("doc_id", F.abs("scaled").alias("magnitude"), F.col("context_id"), F.col("period_end").alias("_e")), ["doc_id", "magnitude"], "left")
    ok = F.col("context_id").isNotNull() & (F.col("period_end").isNull() | (F.col("period_end") == F.col("_e")))
    g = j.groupBy("cell_id").agg(F.count_distinct(F.when(ok, F.col("context_id"))).alias("n"), F.min(F.when(ok, F.col("context_id"))).alias("c"))
    return g.select("cell_id", F.when(F.col("n") == 1, F.col("c")).alias("context_id"), F.when(F.col("n") == 1, "assigned_unique").when(F.col("n") > 1, "rejected_ambiguous").otherwise("no_compatible_fact").alias("status"))
