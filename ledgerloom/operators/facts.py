"""Exact queries over a catalog of facts: (fact_id, accession, concept, company, form, unit, value, period_start, period_end, instant)."""

from __future__ import annotations

import re
from decimal import Context, Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import compact, local_name, name_tokens
from ..sources.canonical import corpus_fingerprint
from .calculator import canonical

FILTERS = ("accession", "company", "form", "unit", "period_start", "period_end", "instant")


class UnknownConcept(ValueError):
    """A concept that no fact has."""


def query(facts: DataFrame, concept: str, **filters) -> DataFrame:
    """Facts of a concept that meet every filter, by fact_id. A filter left out doesn't filter, an empty string is a value; an instant excludes a period.
    An unknown concept is an error; a known one without matches has no rows."""
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"unknown filters {sorted(unknown)}")
    if filters.get("instant") is not None and any(filters.get(k) is not None for k in ("period_start", "period_end")):
        raise ValueError("an instant excludes a period")
    own = facts.filter(F.col("concept") == concept)
    for k, v in filters.items():
        if v is not None:
            own = own.filter(F.col(k) == F.lit(v))
    if not own.head(1) and not facts.filter(F.col("concept") == concept).head(1):
        raise UnknownConcept(concept)
    return own.orderBy("fact_id")


def search(facts: DataFrame, text: str, k: int = 10) -> DataFrame:
    """(concept, tier, overlap, matched_count, rank): 0 the qualified name, 1 the local name, 2 within the local name, 3 within the qualified name, 4 a
    common word; ties by overlap, difference in length and name."""
    if not 1 <= k <= 50 or not text.strip():
        raise ValueError("1 <= k <= 50 and some text")
    text = text.strip()
    q = F.lit(text)
    names = facts.select("concept").distinct().withColumn("local", local_name(F.col("concept")))
    overlap = F.size(F.array_intersect(name_tokens(F.col("concept")), name_tokens(q)))
    tier = F.when(F.col("concept") == q, 0).when(F.col("local") == q, 1).when(F.contains(compact(F.col("local")), compact(q)), 2)
    tier = tier.when(F.contains(compact(F.col("concept")), compact(q)), 3).when(overlap >= 1, 4)
    hits = names.withColumn("tier", tier).withColumn("overlap", overlap).filter("tier IS NOT NULL").withColumn("d", F.abs(F.length("local") - F.length(q)))
    n = hits.agg(F.count("*").alias("matched_count"))
    top = hits.orderBy("tier", F.desc("overlap"), "d", "concept").limit(k)
    w = Window.orderBy("tier", F.desc("overlap"), "d", "concept")
    return top.withColumn("rank", F.row_number().over(w)).crossJoin(F.broadcast(n)).select("concept", "tier", "overlap", "matched_count", "rank")


def observations(facts: DataFrame, lists: tuple = ("unit",), counts: tuple = ("company", "accession")) -> DataFrame:
    """What is known of each concept: the number of facts, sorted distinct values of `lists` (few by nature: units, forms), numbers of distinct values of
    `counts` (as n_<column>). Empty values are left out. Distinct values are found before they are grouped, so no group of facts is gathered."""
    out = facts.groupBy("concept").agg(F.count("*").alias("fact_count"))
    for c in (*lists, *counts):
        some = facts.select("concept", F.col(c).cast("string").alias("_v")).filter("_v <> ''").distinct().groupBy("concept")
        got = some.agg(F.array_sort(F.collect_list("_v")).alias(c + "s")) if c in lists else some.agg(F.count("*").alias("n_" + c))
        out = out.join(got, "concept", "left")
    return out.withColumns({c + "s": F.coalesce(c + "s", F.array().cast("array<string>")) for c in lists} | {"n_" + c: F.coalesce("n_" + c, F.lit(0)) for c in counts})


def enriched(facts: DataFrame, references: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """facts joined with what they refer to: references[name] = (column of facts, relation, its key). Every column of a relation comes along but its key; a fact
    is never dropped: `broken` lists the references that have no row."""
    out, missing = facts, []
    for name, (fk, parent, pk) in references.items():
        own = parent.withColumnRenamed(pk, f"_{name}").withColumn(f"_has_{name}", F.lit(True))
        out = out.join(own, F.col(fk) == F.col(f"_{name}"), "left").drop(f"_{name}")
        missing.append(F.when(F.col(f"_has_{name}").isNull(), F.lit(name)))
    return out.withColumn("broken", F.array_compact(F.array(*missing))).drop(*[f"_has_{n}" for n in references])


def chunk_links(chunks: DataFrame, doc: str = "doc_id", chunk: str = "chunk_id", facts: str = "fact_ids") -> tuple[DataFrame, DataFrame]:
    """chunks with arrays of fact ids -> (links (doc, fact, chunk), one for each fact of a document; report of facts that several chunks claim)."""
    each = chunks.select(doc, chunk, F.explode(facts).alias("fact_id")).distinct()
    n = each.groupBy(doc, "fact_id").agg(F.count("*").alias("n"), F.min(chunk).alias(chunk))
    return n.filter("n = 1").select(doc, "fact_id", chunk), n.filter("n > 1").select(F.lit("a fact has one chunk").alias("rule"), F.concat_ws("-", doc, "fact_id").alias("key"), "n")


#: The fields of a public fact, in order.
PUBLIC_FIELDS = (
    "fact_id", "doc_id", "accession", "source_role", "doc_role", "company", "cik", "entity_identifier", "entity_scheme", "form_type", "filing_date", "period_of_report", "fiscal_period",
    "calendar_period", "concept", "local_name", "context_id", "period_type", "period_start", "period_end", "instant", "duration_days", "unit", "unit_measures", "decimals", "scale", "sign",
    "raw_visible_text", "parsed_value", "normalized_value", "is_negative", "dimensions", "members", "chunk_id", "locator", "corpus_fingerprint", "schema_version",
)


def public(facts: DataFrame, include_dimensions: bool = True, fields: tuple = PUBLIC_FIELDS) -> DataFrame:
    """Facts as they are given out: every public field in order, null where the source has none; typed periods; the exact value as plain digits; dimensions only
    where they are asked for (the number of rows stays)."""
    out = period_type(facts)
    have = lambda c, kind: F.col(c).cast(kind) if c in out.columns else F.lit(None).cast(kind)
    if "normalized_value" not in out.columns:
        shown = have("raw_visible_text", "string") if "raw_visible_text" in out.columns else have("value", "decimal(38,10)").cast("string")
        out = out.withColumn("normalized_value", exact_value(shown, have("scale", "int"), have("sign", "string")))
    if "local_name" not in out.columns:
        out = out.withColumn("local_name", local_name(F.col("concept")))
    if not include_dimensions:
        out = out.drop("dimensions", "members")
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in fields])


def trace(facts: DataFrame, got: DataFrame, filters: dict) -> DataFrame:
    """One row about a query: the filters that were set, how many facts there are and were found, a fingerprint of the ids found that no partitioning changes and
    no task gathers."""
    ids = got.select(F.sha2(F.col("fact_id").cast("string").cast("binary"), 256).alias("h"))
    found = got.agg(F.count("*").alias("matched_count")).crossJoin(corpus_fingerprint(ids, "h", "facts"))
    applied = F.to_json(F.create_map(*[x for k, v in sorted(filters.items()) if v is not None for x in (F.lit(k), F.lit(str(v)))])) if any(v is not None for v in filters.values()) else F.lit("{}")
    return facts.agg(F.count("*").alias("fact_count")).crossJoin(found).withColumn("filters", applied)


def period_type(facts: DataFrame) -> DataFrame:
    """Adds period_type and duration_days; a fact with both kinds or neither, or that ends before it starts, is `invalid`."""
    duration = F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    days = F.datediff("period_end", "period_start") + 1
    kind = F.when(F.col("instant").isNotNull() & F.col("period_start").isNull() & F.col("period_end").isNull(), "instant").when(F.col("instant").isNull() & duration & (days >= 1), "duration").otherwise("invalid")
    return facts.withColumn("period_type", kind).withColumn("duration_days", F.when(kind == "duration", days))


@F.pandas_udf(T.StringType())
def exact_value(raw: pd.Series, scale: pd.Series, sign: pd.Series) -> pd.Series:
    """The shown number times ten to its scale, exactly, as plain digits; null if it isn't a number."""

    def one(text, power, minus):
        shown = re.sub(r"[,\s]", "", text or "")
        negative = minus == "-" or shown.startswith(("-", "("))
        digits = shown.strip("()").lstrip("+-")
        if not re.fullmatch(r"[0-9]+(\.[0-9]+)?", digits):
            return None
        value = Decimal(digits).scaleb(0 if pd.isna(power) else int(power), Context(prec=200))
        return canonical(value.copy_negate() if negative else value)

    return pd.Series([one(*x) for x in zip(raw, scale, sign)], dtype=object)


def consistency(pairs: DataFrame) -> DataFrame:
    """Cells beside facts (cell_* and fact_* of value, scale, end, months, unit): what agrees, one column each, and all of it. What a side doesn't state
    can't disagree, but for the magnitude."""
    stated = lambda a, b: F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b))
    cell = F.col("cell_value") * F.pow(F.lit(10.0), F.coalesce("cell_scale", F.lit(0)))
    checks = {
        "magnitude_ok": F.abs(F.abs(cell) - F.abs("fact_value")) <= 1e-9 * F.abs("fact_value"), "sign_ok": F.signum("cell_value") == F.signum("fact_value"),
        "end_ok": stated("cell_end", "fact_end"), "months_ok": stated("cell_months", "fact_months"), "unit_ok": stated("cell_unit", "fact_unit"),
    }
    out = pairs.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in checks.items()})
    return out.withColumn("consistent", F.forall(F.array(*checks), lambda x: x))


def violations(facts: DataFrame) -> DataFrame:
    """(rule, key, n): repeated fact ids, and accessions with more than one company."""
    again = facts.groupBy("fact_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("fact_id is unique").alias("rule"), F.col("fact_id").cast("string").alias("key"), "n")
    many = facts.groupBy("accession").agg(F.countDistinct("company").alias("n")).filter("n > 1").select(F.lit("accession determines company").alias("rule"), F.col("accession").cast("string").alias("key"), "n")
    return again.unionByName(many)
