"""Fact queries, checks, units, periods, requirement graphs and release operations over the star schema.

Each function takes a dialect and returns SQL; `filings` runs operators for most of them and has this SQL beside it. Facts are line items: accession = order, concept = return flag and line status, company = customer,
period = order date to ship date, unit = the supplier's nation.
"""

from __future__ import annotations

FACT_ID = "concat(cast(l.l_orderkey as string), '-', cast(l.l_linenumber as string), '-', cast(l.l_partkey as string), '-', cast(l.l_suppkey as string))"


def facts(d) -> str:
    return f"""facts AS (
  SELECT {FACT_ID} AS fact_id, l.l_orderkey AS accession, concat('li:', l.l_returnflag, l.l_linestatus) AS concept, o.o_custkey AS company,
         c.c_mktsegment AS form, l.l_suppkey AS unit, round(l.l_extendedprice, 2) AS value, l.l_quantity AS quantity, l.l_discount AS discount,
         cast(o.o_orderdate as date) AS period_start, cast(l.l_shipdate as date) AS period_end, l.l_partkey AS part, l.l_linenumber AS line
  FROM {d.t("lineitem")} l JOIN {d.t("orders")} o ON l.l_orderkey = o.o_orderkey JOIN {d.t("customer")} c ON o.o_custkey = c.c_custkey)"""


def facts_query_exact(d) -> str:
    return f"""WITH {facts(d)}
SELECT fact_id, accession, concept, company, form, value, period_end FROM facts
WHERE concept = 'li:RF' AND form = 'BUILDING' AND period_end >= DATE '1996-01-01' AND period_end < DATE '1997-01-01' AND value > 50000"""


def facts_query_unknown_concept(d) -> str:
    """An unknown concept is an error for the caller; a known one without matching facts has no rows: told apart here."""
    return f"""WITH {facts(d)}, asked AS (SELECT 'li:RF' AS concept UNION ALL SELECT 'li:ZZ' UNION ALL SELECT 'li:AF')
SELECT asked.concept, count(facts.fact_id) > 0 AS known, cast(count(CASE WHEN form = 'MACHINERY' AND value < 0 THEN 1 END) as bigint) AS n_rows
FROM asked LEFT JOIN facts ON asked.concept = facts.concept GROUP BY asked.concept"""


def concept_search_tiers(d, query: str = "Ring") -> str:
    compact = lambda x: d.replace(f"lower({x})", "[^a-z0-9]", "")
    return f"""WITH concepts AS (SELECT DISTINCT concat(p_brand, ':', p_name) AS concept, p_name AS local FROM {d.t("part")}),
q AS (SELECT '{query}' AS q, {compact(f"'{query}'")} AS cq, {d.words(f"'{query}'")} AS qt),
matched AS (
  SELECT concept, local, CASE WHEN concept = q THEN 0 WHEN local = q THEN 1 WHEN {d.contains(compact("local"), "cq")} THEN 2
           WHEN {d.contains(compact("concept"), "cq")} THEN 3 WHEN {d.overlap(d.words("concept"), "qt")} >= 1 THEN 4 END AS tier,
         {d.overlap(d.words("concept"), "qt")} AS overlap, abs(length(local) - length(q)) AS len_diff
  FROM concepts CROSS JOIN q),
kept AS (SELECT *, count(*) OVER () AS matched_count, row_number() OVER (ORDER BY tier, overlap DESC, len_diff, concept) AS rank FROM matched WHERE tier IS NOT NULL)
SELECT concept, cast(tier as bigint) AS tier, cast(overlap as bigint) AS overlap, cast(len_diff as bigint) AS len_diff, cast(matched_count as bigint) AS matched_count, cast(rank as bigint) AS rank
FROM kept WHERE rank <= 10"""


def concept_observations(d) -> str:
    return f"""WITH {facts(d)}
SELECT concept, cast(count(*) as bigint) AS fact_count, cast(count(DISTINCT unit) as bigint) AS n_units, {d.strset("form")} AS forms,
       cast(count(DISTINCT company) as bigint) AS n_companies, cast(count(DISTINCT accession) as bigint) AS n_accessions, min(period_end) AS first_end, max(period_end) AS last_end
FROM facts GROUP BY concept"""


def facts_enriched(d) -> str:
    """Fact, company, nation and region; missing references stay null and are flagged, none is dropped."""
    return f"""SELECT {FACT_ID} AS fact_id, c.c_name AS company, n.n_name AS nation, r.r_name AS region, s.s_name AS unit_name, p.p_brand AS brand,
       (o.o_orderkey IS NULL OR c.c_custkey IS NULL OR s.s_suppkey IS NULL OR p.p_partkey IS NULL) AS broken, round(l.l_extendedprice * (1 - l.l_discount), 4) AS net
FROM {d.t("lineitem")} l LEFT JOIN {d.t("orders")} o ON l.l_orderkey = o.o_orderkey LEFT JOIN {d.t("customer")} c ON o.o_custkey = c.c_custkey
LEFT JOIN {d.t("nation")} n ON c.c_nationkey = n.n_nationkey LEFT JOIN {d.t("region")} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN {d.t("supplier")} s ON l.l_suppkey = s.s_suppkey LEFT JOIN {d.t("part")} p ON l.l_partkey = p.p_partkey"""


def fact_fd_violations(d) -> str:
    """Functional dependencies that must hold: an accession has one company and status; a part name one brand."""
    return f"""SELECT 'accession->company' AS dependency, cast(o_orderkey as string) AS determinant, cast(count(DISTINCT o_custkey) as bigint) AS n_values FROM {d.t("orders")} GROUP BY o_orderkey HAVING count(DISTINCT o_custkey) > 1
UNION ALL SELECT 'part name->brand', p_name, cast(count(DISTINCT p_brand) as bigint) FROM {d.t("part")} GROUP BY p_name HAVING count(DISTINCT p_brand) > 1
UNION ALL SELECT 'accession,line->part', concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)), cast(count(DISTINCT l_partkey) as bigint) FROM {d.t("lineitem")} GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_partkey) > 1"""


def fk_orphans(d) -> str:
    anti = lambda name, child, fk, parent, pk: f"SELECT '{name}' AS reference, cast({fk} as string) AS value, cast(count(*) as bigint) AS n FROM {d.t(child)} x WHERE {fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {d.t(parent)} y WHERE y.{pk} = x.{fk}) GROUP BY {fk}"
    return "\nUNION ALL ".join([anti("labels.doc_id", "labels", "doc_id", "documents", "doc_id"), anti("orders.custkey", "orders", "o_custkey", "customer", "c_custkey"), anti("lineitem.orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"), anti("lineitem.partkey", "lineitem", "l_partkey", "part", "p_partkey"), anti("lineitem.suppkey", "lineitem", "l_suppkey", "supplier", "s_suppkey")])


def duplicate_ids(d) -> str:
    one = lambda t, k: f"SELECT '{t}' AS relation, cast(count(*) as bigint) AS n_rows, cast(count(DISTINCT {k}) as bigint) AS n_ids, cast(count(*) - count(DISTINCT {k}) as bigint) AS n_surplus FROM {d.t(t)}"
    return "\nUNION ALL ".join(one(*x) for x in (("documents", "doc_id"), ("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("events", "event_id"), ("pages", "page_id"), ("embeddings", "vec_id"), ("benchmark", "item_id"), ("lineitem", "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string))")))


# --- units and precision

UNITS = """registry AS (
  SELECT * FROM (VALUES ('USD', 1.0, 'monetary', 'USD'), ('USD_thousand', 1000.0, 'monetary', 'USD'), ('USD_million', 1000000.0, 'monetary', 'USD'), ('USD_billion', 1000000000.0, 'monetary', 'USD'),
    ('shares', 1.0, 'share_count', 'shares'), ('shares_thousand', 1000.0, 'share_count', 'shares'), ('shares_million', 1000000.0, 'share_count', 'shares'), ('shares_billion', 1000000000.0, 'share_count', 'shares'),
    ('USD_per_share', 1.0, 'monetary_per_share', 'USD_per_share'), ('USD_per_basic_share', 1.0, 'monetary_per_share', 'USD_per_share'), ('USD_per_diluted_share', 1.0, 'monetary_per_share', 'USD_per_share'), ('pure', 1.0, 'ratio', 'pure'), ('percent', 0.01, 'ratio', 'pure'), ('percentage_point', 1.0, 'percentage_point', 'percentage_point')) AS r(label, factor, dimension, canonical))"""
#: The unit that each measured column is stated in.
MEASURES = """measures AS (
  SELECT fact_id, company, concept, 'USD' AS unit, value AS v, cast(value as double) AS base FROM facts UNION ALL
  SELECT fact_id, company, concept, 'USD_thousand', value / 1000, value FROM facts UNION ALL
  SELECT fact_id, company, concept, 'percent', discount * 100, discount FROM facts UNION ALL
  SELECT fact_id, company, concept, 'pure', discount, discount FROM facts UNION ALL
  SELECT fact_id, company, concept, 'boxes', quantity, quantity FROM facts)"""


def unit_normalise(d) -> str:
    return f"""WITH {facts(d)}, {UNITS}, {MEASURES}
SELECT m.unit, r.dimension, r.canonical, r.label IS NOT NULL AS registered, cast(count(*) as bigint) AS n, round(sum(cast(m.v as double) * cast(r.factor as double)) / 1000, 3) AS total_thousands
FROM measures m LEFT JOIN registry r ON m.unit = r.label GROUP BY m.unit, r.dimension, r.canonical, r.label"""


def unit_comparison(d) -> str:
    """Identical label, else both registered with one dimension and canonical unit, else why not."""
    return f"""WITH {UNITS}, labels_ AS (SELECT label FROM registry UNION ALL SELECT 'boxes' UNION ALL SELECT 'crates')
SELECT a.label AS a, b.label AS b, CASE WHEN a.label = b.label THEN 'exact_label_match' WHEN x.label IS NULL OR y.label IS NULL THEN 'unregistered_unit'
         WHEN x.dimension = y.dimension AND x.canonical = y.canonical THEN 'registered_equivalence' ELSE 'dimension_mismatch' END AS status
FROM labels_ a CROSS JOIN labels_ b LEFT JOIN registry x ON a.label = x.label LEFT JOIN registry y ON b.label = y.label"""


def precision_match(d) -> str:
    """Order totals against the sums of their lines: exact, at a quantum of 10 (half to even on both sides), within a tolerance of 5%."""
    return f"""WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS lines FROM {d.t("lineitem")} GROUP BY l_orderkey)
SELECT o_orderkey, o_totalprice, lines, o_totalprice = lines AS exact_match, {d.half_even("o_totalprice / 10")} = {d.half_even("lines / 10")} AS quantum_match,
       abs(o_totalprice - lines) <= 0.05 * abs(o_totalprice) AS tolerance_match, CASE WHEN o_totalprice = lines THEN 'equivalent' WHEN o_totalprice = -lines THEN 'opposite_sign_magnitude_only' ELSE 'different' END AS comparison
FROM {d.t("orders")} JOIN s ON o_orderkey = l_orderkey"""


# --- mapping stages

TARGETS = """targets AS (SELECT o_orderkey AS target_id, o_custkey AS company, cast(o_orderdate as date) AS at, o_totalprice AS value FROM {orders})"""


def stage1_candidates(d) -> str:
    """Facts linked to the target's own accession, of its company and above a tenth of its value."""
    return f"""WITH {facts(d)}, {TARGETS.replace("{orders}", d.t("orders"))}
SELECT t.target_id, f.fact_id, f.concept, f.value FROM targets t JOIN facts f ON f.accession = t.target_id AND f.company = t.company WHERE f.value >= 0.1 * t.value"""


def stage2_candidates(d) -> str:
    """Passing parents with facts of other accessions that agree in company, concept, part and quantity: duplicates across filings."""
    return f"""WITH {facts(d)}
SELECT a.fact_id AS parent_id, b.fact_id AS fact_id, a.company, a.concept, a.part FROM facts a JOIN facts b ON a.company = b.company AND a.concept = b.concept AND a.part = b.part AND a.accession <> b.accession"""


def stage3_candidates(d) -> str:
    """The constrained search: same company and year as the target, not seen at an earlier stage, best value match by order of distance."""
    return f"""WITH {facts(d)}, {TARGETS.replace("{orders}", d.t("orders"))}, seen AS (SELECT DISTINCT accession AS target_id, fact_id FROM facts),
near AS (SELECT t.target_id, f.fact_id, abs(f.value - t.value) AS distance FROM targets t JOIN facts f ON f.company = t.company AND f.period_start = t.at
         WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.target_id = t.target_id AND s.fact_id = f.fact_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY distance, fact_id) AS rank FROM near)
SELECT target_id, fact_id, round(distance, 2) AS distance, cast(rank as bigint) AS rank FROM ranked WHERE rank <= 3"""


def mapping_status(d) -> str:
    """Any pass maps a target; else any unresolved leaves it unmappable; else a completed search finds no counterpart."""
    return f"""WITH {facts(d)}, {TARGETS.replace("{orders}", d.t("orders"))},
checks AS (SELECT t.target_id, CASE WHEN f.fact_id IS NULL THEN NULL WHEN f.value >= 0.5 * t.value THEN 'PASS' WHEN f.period_end < f.period_start THEN 'UNRESOLVED' ELSE 'REJECT' END AS result
  FROM targets t LEFT JOIN facts f ON f.accession = t.target_id)
SELECT target_id, CASE WHEN count(CASE WHEN result = 'PASS' THEN 1 END) > 0 THEN 'mapped' WHEN count(CASE WHEN result = 'UNRESOLVED' THEN 1 END) > 0 THEN 'unmappable'
  WHEN count(result) > 0 THEN 'no_counterpart' ELSE 'unmappable_without_search' END AS status, cast(count(result) as bigint) AS n_checks FROM checks GROUP BY target_id"""


# --- periods


def duration_months(d) -> str:
    days = d.days("period_start", "period_end")
    return f"""WITH {facts(d)}
SELECT fact_id, cast({days} as bigint) AS days, CASE WHEN {days} >= 0 THEN cast(greatest(1, {d.half_even(f"({days} + 1) / (365.2425 / 12)")}) as bigint) ELSE -1 END AS months FROM facts"""


def temporal_catalog(d) -> str:
    """Contexts: one row for each accession and period, with what is stated there; a period of one day is an instant."""
    return f"""WITH {facts(d)}
SELECT accession, CASE WHEN period_start = period_end THEN 'instant' ELSE 'duration' END AS kind, CASE WHEN period_start <> period_end THEN period_start END AS period_start, period_end,
       cast(count(*) as bigint) AS n_facts, {d.strset("concept")} AS concepts FROM facts WHERE period_end >= period_start GROUP BY accession, period_start, period_end"""


def header_vs_fact_period_conflicts(d) -> str:
    """A column is an accession's concept: more than one period is a conflict, a period that contradicts the order's is another."""
    return f"""WITH {facts(d)}, cols AS (SELECT accession, concept, cast(count(DISTINCT period_end) as bigint) AS n_periods, min(period_end) AS low, max(period_end) AS high, min(period_start) AS start_ FROM facts GROUP BY accession, concept)
SELECT accession, concept, n_periods, low, high, CASE WHEN n_periods > 1 THEN 'column_period' ELSE 'contradicts_header' END AS conflict FROM cols WHERE n_periods > 1 OR high < start_"""


def temporal_resolution(d) -> str:
    """Exact period, else a unique linked context, else ambiguous, else a unique period of the company, else unresolved."""
    return f"""WITH {facts(d)}, own AS (SELECT accession, count(DISTINCT period_end) AS n, min(period_end) AS only_end, max(CASE WHEN period_end = period_start THEN 1 ELSE 0 END) AS exact_ FROM facts GROUP BY accession),
firm AS (SELECT o_custkey, count(DISTINCT cast(o_orderdate as date)) AS n, min(cast(o_orderdate as date)) AS only_day FROM {d.t("orders")} GROUP BY o_custkey)
SELECT o.o_orderkey AS target_id, CASE WHEN own.exact_ = 1 THEN 'exact' WHEN own.n = 1 THEN 'unique_context' WHEN own.n > 1 THEN 'ambiguous' WHEN firm.n = 1 THEN 'unique_company_period' ELSE 'unresolved' END AS resolution,
       CASE WHEN own.exact_ = 1 THEN cast(o.o_orderdate as date) WHEN own.n = 1 THEN own.only_end WHEN own.n > 1 THEN NULL WHEN firm.n = 1 THEN firm.only_day END AS resolved
FROM {d.t("orders")} o LEFT JOIN own ON own.accession = o.o_orderkey LEFT JOIN firm ON firm.o_custkey = o.o_custkey"""


# --- requirement graphs: what a region's figure is derived from


EDGES = """edges AS (
  SELECT concat('R', cast(r_regionkey as string)) AS parent, concat('N', cast(n_nationkey as string)) AS child FROM {nation} JOIN {region} ON n_regionkey = r_regionkey UNION ALL
  SELECT concat('N', cast(s_nationkey as string)), concat('S', cast(s_suppkey as string)) FROM {supplier} UNION ALL
  SELECT 'ALL', concat('R', cast(r_regionkey as string)) FROM {region})"""


def _edges(d) -> str:
    return EDGES.replace("{nation}", d.t("nation")).replace("{region}", d.t("region")).replace("{supplier}", d.t("supplier"))


def requirement_closure(d) -> str:
    """Each derived figure with the distinct leaves it depends on."""
    return f"""WITH RECURSIVE {_edges(d)}, reach AS (SELECT parent AS root, child FROM edges UNION ALL SELECT r.root, e.child FROM reach r JOIN edges e ON e.parent = r.child)
SELECT root, cast(count(DISTINCT child) as bigint) AS n_leaves, min(child) AS first_leaf, max(child) AS last_leaf FROM reach WHERE child NOT IN (SELECT parent FROM edges) GROUP BY root"""


def topo_levels(d) -> str:
    """The longest way down from a root: inputs come at higher levels."""
    return f"""WITH RECURSIVE {_edges(d)}, walk AS (SELECT DISTINCT parent AS node, cast(0 as bigint) AS level FROM edges WHERE parent NOT IN (SELECT child FROM edges)
  UNION ALL SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.node)
SELECT node, max(level) AS level FROM walk GROUP BY node"""


def cycle_check(d) -> str:
    """Nodes that reach themselves; the last edge closes a cycle through the first nation's region."""
    return f"""WITH RECURSIVE {_edges(d)}, closed AS (SELECT parent, child FROM edges WHERE parent <> 'ALL' UNION ALL SELECT 'S0', concat('R', cast(n_regionkey as string)) FROM {d.t("nation")} n JOIN {d.t("supplier")} s ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey = 0),
steps AS (SELECT parent AS root, child, 1 AS depth FROM closed UNION ALL SELECT s.root, c.child, s.depth + 1 FROM steps s JOIN closed c ON c.parent = s.child WHERE s.depth < 4 AND s.child <> s.root)
SELECT DISTINCT root AS node FROM steps WHERE root = child"""


# --- provenance


def source_fingerprints(d) -> str:
    norm = f"trim({d.replace('lower(text)', '[ \\t\\n\\r]+', ' ')})"
    return f"""SELECT doc_id, {d.sha256(norm)} AS fingerprint, cast(length({norm}) as bigint) AS n_chars FROM {d.t("documents")}"""


def exact_duplicate_docs(d) -> str:
    return f"""SELECT {d.sha256("text")} AS fingerprint, cast(count(*) as bigint) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM {d.t("documents")} GROUP BY {d.sha256("text")} HAVING count(*) > 1"""


def label_distribution(d) -> str:
    return f"""SELECT d.lang, d.source, cast(count(*) as bigint) AS n_docs, cast(count(l.doc_id) as bigint) AS n_labelled, cast(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) as bigint) AS n_good,
       cast(sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END) as bigint) AS n_toxic FROM {d.t("documents")} d LEFT JOIN {d.t("labels")} l ON d.doc_id = l.doc_id GROUP BY d.lang, d.source"""


# --- audits and release


def micro_average(d) -> str:
    """Sum of numerators over sum of denominators of the applicable slots, never the mean of ratios; slots without a denominator don't apply."""
    return f"""SELECT o_orderpriority, cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) as bigint) AS numerator, cast(count(*) as bigint) AS denominator,
       round(cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) as double) / count(*), 9) AS micro FROM {d.t("lineitem")} JOIN {d.t("orders")} ON l_orderkey = o_orderkey GROUP BY o_orderpriority"""


def variant_selection(d) -> str:
    """Of each order's lines in order: the first that passes, else the first."""
    return f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount > 0.05 DESC, l_linenumber, l_partkey, l_suppkey) AS rank FROM {d.t("lineitem")})
SELECT l_orderkey, cast(l_linenumber as bigint) AS variant, l_partkey, l_suppkey, l_discount > 0.05 AS passed FROM v WHERE rank = 1"""


def relational_division(d) -> str:
    """Customers whose orders cover every priority: approved paths of which all members are cited."""
    return f"""SELECT o_custkey, cast(count(DISTINCT o_orderpriority) as bigint) AS n_members FROM {d.t("orders")} GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM {d.t("orders")})"""


def _errata(d) -> str:
    return f"""errata AS (SELECT s_suppkey, 's_acctbal' AS field, s_acctbal AS old_value, round(s_acctbal + 100, 2) AS new_value FROM {d.t("supplier")} WHERE s_acctbal < 0
  UNION ALL SELECT s_suppkey, 's_acctbal', s_acctbal + 1, 0.0 FROM {d.t("supplier")} WHERE s_acctbal > 9000)"""


def errata_overlay(d) -> str:
    """A correction applies where its old value is the one on record; the others are reported and change nothing."""
    return f"""WITH {_errata(d)}
SELECT s.s_suppkey, s.s_name, CASE WHEN e.old_value = s.s_acctbal THEN e.new_value ELSE s.s_acctbal END AS s_acctbal,
       CASE WHEN e.s_suppkey IS NULL THEN 'unchanged' WHEN e.old_value = s.s_acctbal THEN 'corrected' ELSE 'old_value_mismatch' END AS status
FROM {d.t("supplier")} s LEFT JOIN errata e ON s.s_suppkey = e.s_suppkey"""


def release_diff(d) -> str:
    """Changed fields between the record and its overlay."""
    return f"""WITH {_errata(d)}, new_ AS (SELECT s.s_suppkey, CASE WHEN e.old_value = s.s_acctbal THEN e.new_value ELSE s.s_acctbal END AS s_acctbal FROM {d.t("supplier")} s LEFT JOIN errata e ON s.s_suppkey = e.s_suppkey)
SELECT o.s_suppkey, 's_acctbal' AS field, o.s_acctbal AS old_value, n.s_acctbal AS new_value FROM {d.t("supplier")} o JOIN new_ n ON o.s_suppkey = n.s_suppkey WHERE o.s_acctbal <> n.s_acctbal"""


def event_type_counts(d) -> str:
    """Grouping sets: overall and for each type."""
    return f"""SELECT event_type, cast(count(*) as bigint) AS n, round(sum(value), 4) AS total, cast(grouping(event_type) as bigint) AS overall FROM {d.t("events")} GROUP BY GROUPING SETS ((event_type), ())"""


PLANS = [
    facts_query_exact, facts_query_unknown_concept, concept_search_tiers, concept_observations, facts_enriched, fact_fd_violations, fk_orphans, duplicate_ids, unit_normalise, unit_comparison, precision_match,
    stage1_candidates, stage2_candidates, stage3_candidates, mapping_status, duration_months, temporal_catalog, header_vs_fact_period_conflicts, temporal_resolution, requirement_closure, topo_levels, cycle_check,
    source_fingerprints, exact_duplicate_docs, label_distribution, micro_average, variant_selection, relational_division, errata_overlay, release_diff, event_type_counts,
]
