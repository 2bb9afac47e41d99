"""Periods of facts and table columns as a catalog, and what a target's period may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import period_type

#: Sources of a period that state it, and those that ingestion derived it from.
EXPLICIT = ("direct_fact", "xbrl_context", "explicit_range")
DERIVED = ("header", "duration_phrase", "context_lookup", "unique_value")


def contexts(facts: DataFrame, doc: str = "doc_id", *more: str) -> DataFrame:
    """(doc, more, period_type, period_start, period_end, instant, n_facts, concepts): one row for each period that a document states. Distinct concepts come
    first, so no period's facts are gathered."""
    by = [doc, *more, "period_type", "period_start", "period_end", "instant"]
    typed = period_type(facts)
    n = typed.groupBy(*by, "concept").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.sum("n").alias("n_facts"), F.array_sort(F.collect_list("concept")).alias("concepts"))


def evidence_class(sources: Column) -> Column:
    """EXPLICIT_EXACT if every source states the period, INGESTION_DERIVED_OR_INFERRED if some derive it, UNCLEAR if there is none or one isn't known."""
    known = F.array(*[F.lit(x) for x in (*EXPLICIT, *DERIVED)])
    stated = F.array(*[F.lit(x) for x in EXPLICIT])
    clear = (F.size(sources) > 0) & F.forall(sources, lambda x: F.coalesce(F.array_contains(known, x), F.lit(False)))
    return F.when(~F.coalesce(clear, F.lit(False)), "UNCLEAR").when(F.forall(sources, lambda x: F.array_contains(stated, x)), "EXPLICIT_EXACT").otherwise("INGESTION_DERIVED_OR_INFERRED")


def counters(rows: DataFrame, *by: str) -> DataFrame:
    """Audit counts of catalog rows: instants, durations, invalid ones, with dimensions (n_dimensions) where that column is."""
    n = lambda c: F.count(F.when(c, 1))
    many = [n(F.col("n_dimensions") > 0).alias("dimensional")] if "n_dimensions" in rows.columns else []
    kinds = [n(F.col("period_type") == k).alias(k) for k in ("instant", "duration", "invalid")]
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), *kinds, *many)


def target_rows(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """targets (target_id, company, chunk_ids, accessions), rows (company, accession, chunk_ids, period_start, period_end, instant): a target's rows are its company's
    that share a chunk; if none does, those of its accessions. Grouped by period: (target_id, period_start, period_end, instant, n_rows, accessions, how)."""
    r = rows.withColumn("_r", F.xxhash64(*[c for c in ("company", "accession", "chunk_ids", "period_start", "period_end", "instant")]))
    chunk = targets.select("target_id", "company", F.explode("chunk_ids").alias("_c")).join(r.select("*", F.explode("chunk_ids").alias("_c")), ["company", "_c"]).drop("_c").dropDuplicates(["target_id", "_r"])
    rest = targets.join(chunk.select("target_id").distinct(), "target_id", "left_anti")
    named = rest.select("target_id", "company", F.explode(F.array_distinct("accessions")).alias("accession")).join(r, ["company", "accession"])
    cols = ["target_id", "accession", "period_start", "period_end", "instant"]
    both = chunk.select(*cols, F.lit("chunk").alias("how")).unionByName(named.select(*cols, F.lit("accession").alias("how")))
    return both.groupBy("target_id", "period_start", "period_end", "instant", "how").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("accession")).alias("accessions"))


def extract(rows: DataFrame, kind: str, order: list[str], n: int = 5) -> DataFrame:
    """The first n rows of each kind, for review."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def pseudo_targets(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """For tests of the mapping: pairs of catalog rows (company, concept, accession, period_start, period_end, value) that a mapping must tell apart: the same
    concept and period in two filings, two concepts of one period and value, one end with two starts. One pair for each kind and group of `by`, the first in order."""
    a, b = rows.alias("a"), rows.alias("b")
    same = lambda *c: [F.col(f"a.{x}") == F.col(f"b.{x}") for x in c]

    def kind(name: str, on: list[Column], extra: Column) -> DataFrame:
        j = a.join(b, [*on, extra])
        return j.select(F.lit(name).alias("kind"), *[F.col(f"a.{c}").alias(c) for c in by], *[F.col(f"a.{c}").alias(f"first_{c}") for c in order], *[F.col(f"b.{c}").alias(f"second_{c}") for c in order])

    pairs = kind("across_filings", same("company", "concept", "period_start", "period_end"), F.col("a.accession") < F.col("b.accession"))
    pairs = pairs.unionByName(kind("across_concepts", same("company", "accession", "period_start", "period_end", "value"), F.col("a.concept") < F.col("b.concept")))
    pairs = pairs.unionByName(kind("same_end", same("company", "concept", "period_end"), F.col("a.period_start") < F.col("b.period_start")))
    cols = [f"{x}_{c}" for x in ("first", "second") for c in order]
    return extract(pairs.withColumn("_k", F.struct("kind", *by)), "_k", cols, 1).drop("_k")
