"""Queries that run the fact, mapping, period, graph and release operators over the star schema; their DuckDB SQL is written apart, in `relational` and here.

Facts are line items: accession = order, concept = return flag and line status, company = customer, period = order date to ship date, unit = the supplier."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calculator, constraints, facts, graph, intervals, mapping, provenance, runtime, temporal
from . import relational as R
from .dialect import DUCK


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def catalog(s, d):
    li, o, c = table(s, d, "lineitem"), table(s, d, "orders"), table(s, d, "customer")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    fact_id = F.concat_ws("-", *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return j.select(
        fact_id.alias("fact_id"), F.col("l_orderkey").alias("accession"), F.concat(F.lit("li:"), "l_returnflag", "l_linestatus").alias("concept"), F.col("o_custkey").alias("company"), F.col("c_mktsegment").alias("form"),
        F.col("l_suppkey").alias("unit"), F.round("l_extendedprice", 2).alias("value"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("o_orderdate").cast("date").alias("period_start"), F.col("l_shipdate").cast("date").alias("period_end"), F.lit(None).cast("date").alias("instant"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"),
    )


def facts_query_exact(s, d):
    got = facts.query(catalog(s, d), "li:RF", form="BUILDING")
    got = got.filter((F.col("period_end") >= "1996-01-01") & (F.col("period_end") < "1997-01-01") & (F.col("value") > 50000))
    return got.select("fact_id", "accession", "concept", "company", "form", "value", "period_end")


def facts_query_unknown_concept(s, d):
    rows, own = [], catalog(s, d)
    for concept in ("li:RF", "li:ZZ", "li:AF"):
        try:
            rows.append((concept, True, facts.query(own, concept, form="MACHINERY").filter("value < 0").count()))
        except facts.UnknownConcept:
            rows.append((concept, False, 0))
    return s.createDataFrame(rows, "concept string, known boolean, n_rows long")


def concept_search_tiers(s, d):
    names = table(s, d, "part").select(F.concat_ws(":", "p_brand", "p_name").alias("concept"))
    got = facts.search(names, "Ring", 10)
    return got.select("concept", *[F.col(c).cast("long").alias(c) for c in ("tier", "overlap", "matched_count", "rank")])


def concept_observations(s, d):
    got = facts.observations(catalog(s, d), lists=("form",), counts=("unit", "company", "accession"))
    return got.select("concept", "fact_count", F.array_join("forms", ",").alias("forms"), "n_unit", "n_company", "n_accession")


def facts_enriched(s, d):
    li = table(s, d, "lineitem").withColumn("fact_id", F.concat_ws("-", *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))
    t = lambda n, *c: table(s, d, n).select(*c)
    out = facts.enriched(li, {
        "order": ("l_orderkey", t("orders", "o_orderkey", "o_custkey"), "o_orderkey"), "company": ("o_custkey", t("customer", "c_custkey", "c_name", "c_nationkey"), "c_custkey"),
        "unit": ("l_suppkey", t("supplier", "s_suppkey", "s_name"), "s_suppkey"), "part": ("l_partkey", t("part", "p_partkey", "p_brand"), "p_partkey"),
    })
    out = out.join(F.broadcast(t("nation", "n_nationkey", "n_name", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(t("region", "r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("fact_id", F.col("c_name").alias("company"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("s_name").alias("unit_name"), F.col("p_brand").alias("brand"), (F.size("broken") > 0).alias("broken"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


def fact_fd_violations(s, d):
    got = constraints.together(
        constraints.determines(table(s, d, "orders"), ["o_orderkey"], "o_custkey", "accession->company"), constraints.determines(table(s, d, "part"), ["p_name"], "p_brand", "part name->brand"),
        constraints.determines(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", "accession,line->part"),
    )
    return got.select(F.col("rule").alias("dependency"), F.col("key").alias("determinant"), F.col("n").alias("n_values"))


def fk_orphans(s, d):
    """Half of the documents and three quarters of the suppliers are taken away first, so references do break."""
    docs = table(s, d, "documents").filter("doc_id % 2 = 0")
    suppliers = table(s, d, "supplier").filter("s_suppkey % 4 = 0")
    return constraints.together(
        constraints.refers(table(s, d, "labels"), "doc_id", docs, "doc_id", "labels.doc_id"), constraints.refers(table(s, d, "orders"), "o_custkey", table(s, d, "customer"), "c_custkey", "orders.custkey"),
        constraints.refers(table(s, d, "lineitem"), "l_suppkey", suppliers, "s_suppkey", "lineitem.suppkey"),
    ).select(F.col("rule").alias("reference"), F.col("key").alias("value"), "n")


def duplicate_ids(s, d):
    return constraints.together(
        constraints.unique(table(s, d, "orders"), ["o_orderkey"], "orders"), constraints.unique(table(s, d, "part"), ["p_name", "p_brand"], "part"), constraints.unique(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem"),
    )


def _measures(s, d):
    f = catalog(s, d)
    each = [("USD", F.col("value")), ("USD_thousand", F.col("value") / 1000), ("percent", F.col("discount") * 100), ("pure", F.col("discount")), ("boxes", F.col("quantity"))]
    return f.select(F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), v.cast("double").alias("v")) for u, v in each])).alias("m")).select("m.unit", "m.v")


def unit_normalise(s, d):
    got = mapping.with_units(_measures(s, d), "unit", "v")
    out = got.groupBy("unit", "dimension", "canonical").agg(F.count("*").alias("n"), F.round(F.sum("base_value") / 1000, 3).alias("total_thousands"))
    return out.select("unit", "dimension", "canonical", F.col("canonical").isNotNull().alias("registered"), "n", "total_thousands")


def unit_comparison(s, d):
    labels = [*mapping.REGISTRY, "boxes", "crates"]
    return mapping.unit_status(s.createDataFrame([(a, b) for a in labels for b in labels], "a string, b string"))


def precision_match(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("lines"))
    j = table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = F.col("o_totalprice"), F.col("lines")
    return j.select(
        "o_orderkey", "o_totalprice", "lines", mapping.agrees(a, b, mapping.precision_of()).alias("exact_match"), mapping.agrees(a, b, {"mode": "QUANTUM", "quantum": Decimal(10)}, both=True).alias("quantum_match"),
        mapping.agrees(a, b, {"mode": "ABS_TOLERANCE", "tolerance": F.abs(a) * 0.05}).alias("tolerance_match"), mapping.comparison(a, b, mapping.precision_of()).alias("comparison"),
    )


def _targets(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("target_id"), F.col("o_custkey").alias("company"), F.col("o_orderdate").cast("date").alias("at"), F.col("o_totalprice").alias("stated"))


def price_intervals(s, d):
    """Prices within 2% of an order's total, of the same company and year."""
    span = F.col("stated") * 0.02
    t = _targets(s, d).select("target_id", "company", F.year("at").alias("year"), (F.col("stated") - span).alias("low"), (F.col("stated") + span).alias("high"))
    f = catalog(s, d).select("fact_id", "company", F.year("period_start").alias("year"), "value")
    return intervals.within(t, f, "low", "high", "value", ("company", "year")).select("target_id", "fact_id", "value")


def balance_neighbours(s, d):
    """Prices within 5 of ten times a supplier's balance, without any key."""
    t = table(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") * 10 - 5).alias("low"), (F.col("s_acctbal") * 10 + 5).alias("high"))
    near = intervals.within(t, table(s, d, "lineitem").select("l_extendedprice"), "low", "high", "l_extendedprice")
    return near.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


def numeric_matches(s, d):
    """Balances of suppliers, in several units, against those of customers of the nation (basis) in a period that may be missing: within 50 dollars, either sign."""
    even = lambda c: F.when(F.col(c) % 2 == 0, "2024")
    unit = F.when(F.col("s_suppkey") % 3 == 0, "USD").when(F.col("s_suppkey") % 3 == 1, "USD_thousand").otherwise("percent")
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("target_id"), unit.alias("unit"), F.col("s_nationkey").alias("basis"), even("s_suppkey").alias("period"), F.when(unit == "USD_thousand", F.col("s_acctbal") / 1000).otherwise(F.col("s_acctbal")).alias("stated"))
    f = table(s, d, "customer").select(F.col("c_custkey").alias("found_id"), F.lit("USD").alias("unit"), F.col("c_nationkey").alias("basis"), even("c_custkey").alias("period"), F.col("c_acctbal").alias("value"))
    return intervals.numeric_matches(t, f, F.lit(50.0), signed=False)


def stage1_candidates(s, d):
    t = _targets(s, d).withColumn("chunk_ids", F.array("target_id"))
    f = catalog(s, d).withColumn("chunk_id", F.col("accession"))
    return mapping.stage1(t, f, F.col("value") >= 0.1 * F.col("stated")).select("target_id", "fact_id", "concept", "value")


def stage2_candidates(s, d):
    f = catalog(s, d)
    parents = f.withColumn("target_id", F.col("accession"))
    got = mapping.stage2(parents, f, ["company", "concept", "part"])
    return got.select("parent_id", "fact_id", "company", "concept", "part")


def stage3_candidates(s, d):
    f = catalog(s, d).withColumn("at", F.col("period_start"))
    seen = f.select(F.col("accession").alias("target_id"), "fact_id", F.lit(False).alias("passed"))
    got = mapping.stage3(_targets(s, d).withColumn("exact_time", F.lit(True)), f, seen, ["company", "at"], F.lit(True))
    got = got.withColumn("distance", F.abs(F.col("value") - F.col("stated")))
    n = F.row_number().over(Window.partitionBy("target_id").orderBy("distance", "fact_id"))
    return got.withColumn("rank", n.cast("long")).filter("rank <= 3").select("target_id", "fact_id", F.round("distance", 2).alias("distance"), "rank")


def mapping_status(s, d):
    t = _targets(s, d)
    result = F.when(F.col("value") >= 0.5 * F.col("stated"), "PASS").when(F.col("period_end") < F.col("period_start"), "UNRESOLVED").otherwise("REJECT")
    checks = t.join(catalog(s, d), F.col("target_id") == F.col("accession")).select("target_id", result.alias("result"))
    return mapping.statuses(t, checks, checks.select("target_id").distinct())


def duration_months(s, d):
    return catalog(s, d).select("fact_id", F.datediff("period_end", "period_start").cast("long").alias("days"), F.coalesce(T.duration_months(F.col("period_start"), F.col("period_end")).cast("long"), F.lit(-1).cast("long")).alias("months"))


def temporal_catalog(s, d):
    one_day = F.col("period_start") == F.col("period_end")
    f = catalog(s, d).withColumn("instant", F.when(one_day, F.col("period_end"))).withColumn("period_end", F.when(~one_day, F.col("period_end"))).withColumn("period_start", F.when(~one_day, F.col("period_start")))
    got = temporal.contexts(f.withColumnRenamed("accession", "doc"), "doc")
    return got.filter("period_type <> 'invalid'").select(F.col("doc").alias("accession"), F.col("period_type").alias("kind"), "period_start", F.coalesce("period_end", "instant").alias("period_end"), "n_facts", F.array_join("concepts", ",").alias("concepts"))


def header_vs_fact_period_conflicts(s, d):
    cells = catalog(s, d).select(F.col("accession").alias("table_id"), F.col("concept").alias("col"), F.col("period_end").alias("period"), F.when(F.col("line") % 2 == 1, F.col("period_start")).alias("linked_period"))
    return mapping.column_periods(cells).select(F.col("table_id").alias("accession"), F.col("col").alias("concept"), "state", "period")


def temporal_resolution(s, d):
    f, t = catalog(s, d), _targets(s, d)
    exact = f.filter("period_start = period_end").select(F.col("accession").alias("target_id")).distinct().withColumn("_e", F.lit(True))
    asked = t.join(exact, "target_id", "left").select("target_id", F.when(F.col("_e"), F.col("at")).alias("exact"))
    firm = t.select("target_id", "company").join(t.select("company", F.col("at").alias("period")).distinct(), "company").select("target_id", "period")
    return mapping.resolve_time(asked, f.select(F.col("accession").alias("target_id"), F.col("period_end").alias("period")), firm)


def _edges(s, d):
    say = lambda c, k: F.concat(F.lit(c), F.col(k).cast("string"))
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(say("R", "r_regionkey").alias("parent"), say("N", "n_nationkey").alias("child")).unionByName(table(s, d, "supplier").select(say("N", "s_nationkey").alias("parent"), say("S", "s_suppkey").alias("child"))).unionByName(table(s, d, "region").select(F.lit("ALL").alias("parent"), say("R", "r_regionkey").alias("child")))


def requirement_closure(s, d):
    return graph.leaves(_edges(s, d)).groupBy("root").agg(F.count("*").alias("n_leaves"), F.min("leaf").alias("first_leaf"), F.max("leaf").alias("last_leaf"))


def topo_levels(s, d):
    return graph.levels(_edges(s, d)).select("node", F.col("level").cast("long").alias("level"))


def cycle_check(s, d):
    """One more edge closes a cycle through the region of the first supplier's nation."""
    back = table(s, d, "supplier").filter("s_suppkey = 0").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("S0").alias("parent"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("child"))
    return graph.cycles(_edges(s, d).filter("parent <> 'ALL'").unionByName(back)).select("node")


def cycle_members(s, d):
    """Customers in a circle: an urgent order of some size points from its customer to the next order's."""
    o = table(s, d, "orders")
    after = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("child"))
    return graph.cycles(o.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 200000").select("o_orderkey", F.col("o_custkey").alias("parent")).join(after, "o_orderkey").select("parent", "child"))


def source_fingerprints(s, d):
    return table(s, d, "documents").select("doc_id", provenance.fingerprint(F.col("text")).alias("fingerprint"))


def micro_average(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("l_linenumber") == 7, "INFRA_TIMEOUT").when(F.col("l_linenumber") == 6, "FAIL_PARSE").otherwise("OK")
    slots = j.select("o_orderpriority", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("numerator"), F.lit(1).alias("denominator"), status.alias("run_status"))
    got = mapping.micro(slots, ["o_orderpriority"])
    return got.select("o_orderpriority", "numerator", "denominator", F.round("micro", 9).alias("micro"), "n_missing", "state")


def variant_selection(s, d):
    v = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("variant"), "l_partkey", "l_suppkey", (F.col("l_discount") > 0.05).alias("passed"))
    return mapping.selected(v, ["l_orderkey"], "passed", ["variant", "l_partkey", "l_suppkey"])


def relational_division(s, d):
    """Two paths: all priorities but the urgent one, and all but the low one; a customer's orders cite priorities."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("claim_id"), F.col("o_orderpriority").alias("member"))
    members = o.select("member").distinct()
    paths = members.select(F.explode(F.array(F.struct(F.lit("a").alias("path_id"), F.lit("1-URGENT").alias("without")), F.struct(F.lit("b").alias("path_id"), F.lit("5-LOW").alias("without")))).alias("p"), "member").filter("member <> p.without")
    paths = o.select("claim_id").distinct().crossJoin(F.broadcast(paths.select("p.path_id", "member")))
    return mapping.paths_matched(paths, o)


def _errata(s, d):
    sup = table(s, d, "supplier")
    right = sup.filter("s_acctbal < 0").select("s_suppkey", F.lit("s_acctbal").alias("field"), F.col("s_acctbal").cast("string").alias("old_value"), F.round(F.col("s_acctbal") + 100, 2).cast("string").alias("new_value"))
    wrong = sup.filter("s_acctbal > 9000").select("s_suppkey", F.lit("s_acctbal").alias("field"), (F.col("s_acctbal") + 1).cast("string").alias("old_value"), F.lit("0.0").alias("new_value"))
    return right.unionByName(wrong)


def errata_overlay(s, d):
    base = table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    out = mapping.overlay(base, _errata(s, d), "s_suppkey", ["s_acctbal"])
    corrected = out.join(base.select("s_suppkey", F.col("s_acctbal").alias("_was")), "s_suppkey")
    status = F.when(F.size("errors") > 0, "old_value_mismatch").when(F.col("s_acctbal") != F.col("_was"), "corrected").otherwise("unchanged")
    return corrected.select("s_suppkey", "s_name", "s_acctbal", status.alias("status"))


def release_diff(s, d):
    base = table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    out = mapping.diff(base, mapping.overlay(base, _errata(s, d), "s_suppkey", ["s_acctbal"]).drop("errors"), "s_suppkey", ["s_name", "s_acctbal"])
    return out.select("s_suppkey", "field", F.col("old_value").cast("double").alias("old_value"), F.col("new_value").cast("double").alias("new_value"))


def number_parse(s, d):
    """Numbers written into text with grouping, brackets and percent signs, and read back."""
    v, k = F.col("value"), F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("(1,"), F.lpad(F.floor(v).cast("string"), 3, "0"), F.lit(")"))).when(k == 1, F.concat(F.lit("$ "), F.format_string("%.2f", F.floor(v * 100) / 100))).when(k == 2, F.concat(F.format_string("%.1f", F.floor(v * 10) / 10), F.lit(" %"))).otherwise(F.lit("n/a"))
    n = T.parsed_number(raw)
    return table(s, d, "events").filter("value < 1000").select("event_id", n.alias("n")).select("event_id", "n.value", "n.is_percent", "n.is_negative", "n.has_comma")


def formula_exact(s, d):
    """Net amounts in decimals, digit by digit."""
    dec = lambda c: F.col(c).cast("decimal(12,2)")
    net = calculator.calculated("price * (1 - discount) * (1 + tax)", {"price": dec("l_extendedprice"), "discount": dec("l_discount"), "tax": dec("l_tax")}, dict.fromkeys(("price", "discount", "tax"), (12, 2)))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", net.alias("net"))


def derived_lineage(s, d):
    """Regions need their nations' figures, which are mapped where a nation has a supplier in the black."""
    found = table(s, d, "supplier").groupBy(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("target_id")).agg(F.when(F.min("s_acctbal") > 0, "mapped").otherwise("unmappable").alias("status"))
    need = _edges(s, d).filter("parent LIKE 'R%'").select(F.col("parent").alias("target_id"), F.col("child").alias("input_id"))
    return mapping.lineage(need, found)


def target_rows(s, d):
    """Catalog rows of a company: those whose accession is the target's own, else all of the company's."""
    f = catalog(s, d).withColumn("instant", F.lit(None).cast("date"))
    rows = temporal.contexts(f.filter("period_end > period_start").withColumnRenamed("accession", "doc"), "doc", "company").withColumn("chunk_ids", F.array("doc"))
    t = _targets(s, d).filter("target_id % 50 = 0").select("target_id", "company", F.array("target_id").alias("chunk_ids"), F.array("target_id").alias("accessions"))
    got = temporal.target_rows(t, rows.withColumn("accession", F.col("doc")))
    return got.select("target_id", "period_start", "period_end", "n_rows", "how")


def conflict_extract(s, d):
    """The first five rows of every kind of period state."""
    return temporal.extract(header_vs_fact_period_conflicts(s, d), "state", ["accession", "concept"], 5).select("state", "accession", "concept")


def provenance_classes(s, d):
    f = catalog(s, d).groupBy("accession").agg(F.collect_set(F.when(F.col("line") % 3 == 0, "header").when(F.col("line") % 3 == 1, "direct_fact").otherwise("unknown_source")).alias("sources"))
    return f.select("accession", temporal.evidence_class(F.col("sources")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def tool_facts(s, d):
    """The fact tool through the registry: its envelope's ids, or the kind of its error."""
    r = runtime.standard(s, lambda q, k: [], catalog(s, d))
    one = catalog(s, d).orderBy("fact_id").select("concept", "accession").first()
    calls = [{"concept": one.concept, "filters": {"accession": one.accession}}, {"concept": "li:ZZ"}, {"concept": one.concept, "filters": {"no": 1}}, {"concept": " "}]
    rows = []
    for i, a in enumerate(calls):
        e = r.invoke(f"f{i}", "xbrl", "query", a)
        rows += [(i, f["fact_id"], None) for f in e["result"]["facts"]] if e["status"] == "ok" else [(i, None, e["error"]["kind"])]
    return s.createDataFrame(rows, "call long, fact_id string, error string")


QUERIES = {f.__name__: f for f in (
    facts_query_exact, facts_query_unknown_concept, concept_search_tiers, concept_observations, facts_enriched, fact_fd_violations, fk_orphans, duplicate_ids, unit_normalise, unit_comparison, precision_match,
    stage1_candidates, stage2_candidates, stage3_candidates, mapping_status, duration_months, temporal_catalog, header_vs_fact_period_conflicts, temporal_resolution, requirement_closure, topo_levels, cycle_check, cycle_members,
    source_fingerprints, micro_average, variant_selection, relational_division, errata_overlay, release_diff, number_parse, formula_exact, derived_lineage, target_rows, conflict_extract, provenance_classes, tool_facts, price_intervals, balance_neighbours,
    numeric_matches,
)}

_F = R.facts(DUCK)
_STATES = f"""WITH {_F}, g AS (SELECT accession, concept, count(DISTINCT period_end) AS n, min(period_end) AS p, count(DISTINCT CASE WHEN line % 2 = 1 THEN period_start END) AS m, min(CASE WHEN line % 2 = 1 THEN period_start END) AS q FROM facts GROUP BY ALL),
st AS (SELECT accession, concept, CASE WHEN n > 1 THEN 'conflict_column_period' WHEN m > 1 THEN 'conflict_linked_period' WHEN n = 1 AND m = 1 AND p <> q THEN 'conflict_contradiction' WHEN m = 1 THEN 'merged' WHEN n = 1 THEN 'derived' ELSE 'skipped' END AS state, p, q FROM g)"""
_NET = "l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) * (1 + l_tax::DECIMAL(4,2))"
_sql = {f.__name__: f(DUCK) for f in R.PLANS}
ORACLES = {k: _sql[k] for k in QUERIES if k in _sql} | {
    "concept_search_tiers": "SELECT concept, tier, overlap, matched_count, rank FROM (" + _sql["concept_search_tiers"] + ")",
    "concept_observations": f"WITH {_F} SELECT concept, count(*) AS fact_count, string_agg(DISTINCT form, ',' ORDER BY form) AS forms, count(DISTINCT unit) AS n_unit, count(DISTINCT company) AS n_company, count(DISTINCT accession) AS n_accession FROM facts GROUP BY concept",
    "fk_orphans": """SELECT 'labels.doc_id' AS reference, doc_id::VARCHAR AS value, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) GROUP BY doc_id
UNION ALL SELECT 'orders.custkey', o_custkey::VARCHAR, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
UNION ALL SELECT 'lineitem.suppkey', l_suppkey::VARCHAR, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0) GROUP BY l_suppkey""",
    "duplicate_ids": """SELECT 'orders' AS rule, o_orderkey::VARCHAR AS key, count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1 UNION ALL SELECT 'part', p_name || '-' || p_brand, count(*) FROM part GROUP BY p_name, p_brand HAVING count(*) > 1
UNION ALL SELECT 'lineitem', l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "mapping_status": "SELECT target_id, replace(status, '_without_search', '') AS status FROM (" + _sql["mapping_status"] + ")",
    "header_vs_fact_period_conflicts": _STATES + " SELECT accession, concept, state, CASE WHEN state IN ('merged', 'derived') THEN coalesce(q, p) END AS period FROM st",
    "temporal_resolution": "SELECT target_id, resolution, resolved AS period FROM (" + _sql["temporal_resolution"].replace("'unique_company_period' ELSE 'unresolved'", "'unique_table' WHEN firm.n > 1 THEN 'ambiguous' ELSE 'unresolved'") + ")",
    "cycle_check": "WITH RECURSIVE " + _sql["cycle_check"].split("RECURSIVE ", 1)[1].split(", closed AS", 1)[0] + """, closed AS (SELECT parent, child FROM edges WHERE parent <> 'ALL' UNION ALL SELECT 'S0', 'R' || n_regionkey::VARCHAR FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey = 0),
steps AS (SELECT parent AS root, child FROM closed UNION SELECT s.root, c.child FROM steps s JOIN closed c ON c.parent = s.child) SELECT DISTINCT root AS node FROM steps WHERE root = child""",
    "cycle_members": """WITH RECURSIVE e AS (SELECT DISTINCT a.o_custkey AS parent, b.o_custkey AS child FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderpriority = '1-URGENT' AND a.o_totalprice > 200000),
r AS (SELECT parent, child FROM e UNION SELECT r.parent, e.child FROM r JOIN e ON e.parent = r.child)
SELECT a.parent AS node, min(b.parent) AS cycle FROM r a JOIN r b ON b.parent = a.child AND b.child = a.parent GROUP BY a.parent""",
    "source_fingerprints": "SELECT doc_id, fingerprint FROM (" + _sql["source_fingerprints"] + ")",
    "micro_average": """SELECT o_orderpriority, sum(CASE WHEN l_linenumber < 6 AND l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS numerator, sum(CASE WHEN l_linenumber < 7 THEN 1 ELSE 0 END)::BIGINT AS denominator,
  round(sum(CASE WHEN l_linenumber < 6 AND l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN l_linenumber < 7 THEN 1 ELSE 0 END), 9) AS micro, count(CASE WHEN l_linenumber = 7 THEN 1 END) AS n_missing,
  CASE WHEN count(CASE WHEN l_linenumber = 7 THEN 1 END) > 0 THEN 'EVAL_INCOMPLETE' ELSE 'EVAL_COMPLETE' END AS state FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""",
    "variant_selection": "SELECT l_orderkey, variant, l_partkey, l_suppkey, passed FROM (" + _sql["variant_selection"] + ")",
    "relational_division": """SELECT o_custkey AS claim_id, (count(DISTINCT CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END) = (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority <> '1-URGENT'))
  OR (count(DISTINCT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END) = (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority <> '5-LOW')) AS matched FROM orders GROUP BY o_custkey""",
    "number_parse": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN -(1000 + floor(value)) WHEN 1 THEN floor(value * 100) / 100 WHEN 2 THEN floor(value * 10) / 10 END AS value, event_id % 4 = 2 AS is_percent, event_id % 4 = 0 AS is_negative, event_id % 4 = 0 AS has_comma FROM events WHERE value < 1000""",
    "formula_exact": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n = 0 THEN '0' ELSE rtrim(rtrim(n::VARCHAR, '0'), '.') END AS net FROM (SELECT *, {_NET} AS n FROM lineitem)",
    "derived_lineage": """WITH f AS (SELECT s_nationkey AS n, CASE WHEN min(s_acctbal) > 0 THEN 'mapped' ELSE 'unmappable' END AS status FROM supplier GROUP BY s_nationkey)
SELECT 'R' || n_regionkey AS target_id, 'N' || n_nationkey AS input_id, coalesce(status, 'missing') AS status, count(CASE WHEN status = 'mapped' THEN 1 END) OVER (PARTITION BY n_regionkey) = count(*) OVER (PARTITION BY n_regionkey) AS complete FROM nation LEFT JOIN f ON n = n_nationkey""",
    "target_rows": f"""WITH {_F}, c AS (SELECT DISTINCT accession, company, period_start, period_end FROM facts WHERE period_end > period_start), t AS (SELECT o_orderkey AS target_id, o_custkey AS company FROM orders WHERE o_orderkey % 50 = 0),
own AS (SELECT t.target_id, c.* FROM t JOIN c ON c.company = t.company AND c.accession = t.target_id)
SELECT target_id, period_start, period_end, count(*) AS n_rows, 'chunk' AS how FROM own GROUP BY ALL""",
    "conflict_extract": _STATES + " SELECT state, accession, concept FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY accession, concept) AS n FROM st) WHERE n <= 5",
    "provenance_classes": f"WITH {_F}, g AS (SELECT accession, bool_or(line % 3 = 0) AS h, bool_or(line % 3 = 1) AS x, bool_or(line % 3 = 2) AS u FROM facts GROUP BY accession) SELECT CASE WHEN u THEN 'UNCLEAR' WHEN h THEN 'INGESTION_DERIVED_OR_INFERRED' ELSE 'EXPLICIT_EXACT' END AS class, count(*) AS n FROM g GROUP BY ALL",
    "tool_facts": f"WITH {_F}, one AS (SELECT concept, accession FROM facts ORDER BY fact_id LIMIT 1) SELECT 0::BIGINT AS call, fact_id, NULL::VARCHAR AS error FROM facts JOIN one USING (concept, accession) UNION ALL VALUES (1, NULL, 'input'), (2, NULL, 'input'), (3, NULL, 'input')",
    "price_intervals": f"""WITH {_F} SELECT o_orderkey AS target_id, fact_id, value FROM orders JOIN facts ON company = o_custkey AND year(period_start) = year(o_orderdate)
  AND value BETWEEN o_totalprice - o_totalprice * 0.02::DOUBLE AND o_totalprice + o_totalprice * 0.02::DOUBLE""",
    "balance_neighbours": "SELECT s_suppkey, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM supplier JOIN lineitem ON l_extendedprice >= s_acctbal * 10 - 5 AND l_extendedprice <= s_acctbal * 10 + 5 GROUP BY s_suppkey",
    "numeric_matches": """WITH t AS (SELECT *, CASE WHEN s_suppkey % 3 = 1 THEN s_acctbal / 1000 * 1000 ELSE s_acctbal END AS base FROM supplier WHERE s_suppkey % 3 < 2)
SELECT s_suppkey AS target_id, c_custkey AS found_id, sign(base) = sign(c_acctbal) AS same_sign FROM t JOIN customer ON s_nationkey = c_nationkey AND s_suppkey % 2 = c_custkey % 2 AND abs(c_acctbal) >= abs(base) - 50 AND abs(c_acctbal) <= abs(base) + 50""",
}
