"""Filings, tables, facts, mapping and graphs on small hand-made cases."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import blocks, facts, graph, mapping, provenance, tables
from ledgerloom.sources import html, xbrl

FILING = """<html><body><ix:header><xbrli:context id="c1"><xbrli:entity><xbrli:identifier scheme="s">0001</xbrli:identifier><xbrli:segment><xbrldi:explicitMember dimension="us:Axis">us:M</xbrldi:explicitMember>
<xbrldi:typedMember dimension="us:T"><x:v>typed</x:v></xbrldi:typedMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-03-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:period><xbrli:instant>2024-03-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id="eps"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit></ix:header>
<p>Sales <ix:nonFraction id="f1" name="us:Revenue" contextRef="c1" unitRef="usd" scale="6" decimals="-6">1,234.5</ix:nonFraction> and <ix:nonNumeric id="t" name="us:Block" contextRef="c2">loss of
<ix:nonFraction id="f2" name="us:Loss" contextRef="c2" unitRef="eps" sign="-">0.25</ix:nonFraction></ix:nonNumeric> <ix:nonFraction id="f3" name="us:X" contextRef="zz" unitRef="usd">(7)</ix:nonFraction> <ix:nonNumeric id="n" name="us:Name" contextRef="c2">Acme</ix:nonNumeric></p></body></html>"""
TABLE = """<table><caption>Sales in millions</caption><tr><td></td><td colspan=2>Three Months Ended March 31, 2024</td><td>Dec. 31, 2023</td></tr><tr><td></td><td>Net</td><td>%</td><td>Net</td></tr>
<tr><td>Phones (1)</td><td>$1,200</td><td>(5.5%)</td><td>1,100</td></tr><tr><td rowspan=2>Growth rate</td><td>12</td><td></td><td>3 bps</td></tr><tr><td>8</td><td>x</td><td>9</td></tr></table>"""


@pytest.mark.parametrize("cell", [True, False])
def test_one_grammar_of_numbers(cell):
    good = {"5": 5, "-5": -5, "+5": 5, "$1,200.5": 1200.5, "12 %": 12, "3 bps": 3, "-0.5pp": -0.5} | ({"(5)": -5, "(5": -5, "$(1,2%)": -12} if cell else {})
    bad = ["", "5)", "(+-5", "((5", "--5", "+-5", "-(5)", "(-5)", "5.", ".5", "1.2.3", "()", "5-", "a5"] + ([] if cell else ["(5)"])
    assert {t: (tables.number(t, cell) or {}).get("value") for t in [*good, *bad]} == good | dict.fromkeys(bad)


def test_both_parsers_read_alike(spark):
    texts = ["5", "-5", "+5", "(5)", "(5", "$1,200.5", "12 %", "3 bps", "-0.5pp", "(1.5%) pt", "5)", "(+-5", "((5", "--5", "+-5", "(-5)", "5.", "()", "", "1 bp"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.parsed_number(F.col("t")).alias("n")).collect()
    assert {r.t: r.n.value for r in got} == {t: (tables.number(t) or {}).get("value") for t in texts}


def test_passages_with_one_common_word(spark):
    """10^5 passages that share their longest word, short and overlapping ones, one under two ids."""
    passages = [(i, f"a{i} incomprehensibilities b{i}") for i in range(100_000)] + [(-1, "a7 "), (-2, ""), (-3, None), (-4, "a7 incomprehensibilities b7"), (-5, "é")]
    docs = [(1, "x a7 incomprehensibilities b7 a99999 incomprehensibilities b99999"), (2, "incomprehensibilities"), (3, None), (4, "né a7 a7 "), (5, "aa70 incomprehensibilities b7")]
    want = {(p, d, t.index(x)) for p, x in passages if x for d, t in docs if t and x in t}
    given = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")
    for most in (4_000_000, 1_500_000):
        found = provenance.passages_in(*given, most=most)
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_inline_xbrl(spark):
    pages = spark.createDataFrame([("d1", FILING), ("d2", "<p>none"), ("d3", None)], "doc_id string, html string")
    got = {r.fact_id: r for r in xbrl.facts(pages).collect()}
    assert set(got) == {"f1", "f2", "f3", "n"}
    f1, f2, f3 = got["f1"], got["f2"], got["f3"]
    assert (f1.value, f1.scaled, f1.period_end, f1.measures) == (1234.5, 1234500000.0, "2024-03-31", ["iso4217:USD"])
    assert [(d.axis, d.member) for d in f1.dimensions] == [("us:Axis", "us:M"), ("us:T", "typed")] and f1.entity == "0001"
    assert (f2.value, f2.instant, f2.measures, f2.denominator) == (-0.25, "2024-03-31", [], ["xbrli:shares"])
    assert (f3.value, f3.period_end, got["n"].value) == (-7.0, None, None)


@pytest.mark.parametrize("said, found", [("As of March 31, 2024", ["2024-03-31"]), ("Feb 2024 and 2023-12-31", ["2023-12-31", "2024-02-29"]), ("June 30 and 2024", ["2024-06-30"]), ("Feb 30, 2024 or 2024/13/01", []), ("no", [])])
def test_dates(said, found):
    assert [str(d) for d in tables.dates(said)] == found


def test_periods():
    assert tables.period(["Six Months Ended", "June 30, 2024"]) == {"start": None, "end": date(2024, 6, 30), "months": 6, "kind": "duration"}
    assert tables.period(["From January 1, 2024 to March 31, 2024"])["months"] == 3
    assert tables.period(["October 31, 2024"])["kind"] == "instant" and tables.period(["Total"]) is None
    assert tables.months_between(date(2024, 1, 2), date(2024, 1, 1)) is None


def test_table_cells(spark):
    got = tables.cells(spark.createDataFrame([(1, TABLE), (2, None)], "page_id long, html string")).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.label, r.value) for r in got] == [(2, 1, "Phones (1)", 1200.0), (2, 2, "Phones (1)", -5.5), (2, 3, "Phones (1)", 1100.0), (3, 1, "Growth rate", 12.0), (3, 3, "Growth rate", 3.0), (4, 1, "Growth rate", 8.0), (4, 3, "Growth rate", 9.0)]
    assert got[0].header == "Three Months Ended March 31, 2024 Net" and (got[0].months, got[0].period_end, got[0].scale) == (3, date(2024, 3, 31), 6)
    assert got[1].is_percent and got[1].scale is None and got[2].period_start == got[2].period_end == date(2023, 12, 31) and got[0].footnotes == ["1"]
    assert got[4].change_unit == "basis_point" and got[3].is_percent
    said = tables.serialised(html.tree(TABLE).all("table")[0])
    assert said.startswith("Table: Sales in millions\nRow: Phones (1)\n- Three Months Ended March 31, 2024 Net: $1,200")


FACTS = "fact_id string, accession string, concept string, company string, form string, unit string, value double, period_start date, period_end date, instant date"


@pytest.fixture(scope="module")
def catalog(spark):
    d = date
    return spark.createDataFrame([
        ("1", "a", "us:NetIncomeLoss", "X", "10-K", "USD", 1.0, d(2024, 1, 1), d(2024, 12, 31), None), ("2", "a", "us:Assets", "X", "10-K", "USD", 2.0, None, None, d(2024, 12, 31)), ("3", "b", "us:NetIncomeLoss", "X", "10-Q", "", 3.0, d(2024, 1, 1), d(2024, 3, 31), None),
        ("4", "b", "own:IncomeTaxPaid", "Y", "10-Q", "USD", 4.0, d(2024, 3, 1), d(2024, 2, 1), None), ("4", "c", "us:OtherAssetsNet", "Z", "10-Q", "USD", 5.0, None, None, None),
    ], FACTS)


def test_fact_queries(catalog):
    ids = lambda d: [r.fact_id for r in d.collect()]
    assert ids(facts.query(catalog, "us:NetIncomeLoss")) == ["1", "3"] and ids(facts.query(catalog, "us:NetIncomeLoss", unit="")) == ["3"]
    assert ids(facts.query(catalog, "us:NetIncomeLoss", form="8-K")) == [] and ids(facts.query(catalog, "us:Assets", instant=date(2024, 12, 31), unit=None)) == ["2"]
    with pytest.raises(facts.UnknownConcept):
        facts.query(catalog, "us:Nothing").collect()
    with pytest.raises(ValueError):
        facts.query(catalog, "us:Assets", instant=date(2024, 12, 31), period_end=date(2024, 12, 31))
    with pytest.raises(ValueError):
        facts.query(catalog, "us:Assets", colour="red")


def test_concept_search(catalog):
    tiers = lambda q, k=10: [(r.concept, r.tier) for r in facts.search(catalog, q, k).orderBy("rank").collect()]
    assert tiers("us:Assets")[0] == ("us:Assets", 0)
    assert tiers("Assets") == [("us:Assets", 1), ("us:OtherAssetsNet", 2)]
    assert tiers("income tax")[0] == ("own:IncomeTaxPaid", 2) and tiers("NetTotal") == [("us:NetIncomeLoss", 4), ("us:OtherAssetsNet", 4)]
    assert facts.search(catalog, "assets", 1).first().matched_count == 2 and tiers("zebra") == []


def test_periods_and_dependencies(catalog):
    kinds = [(r.fact_id, r.period_type, r.duration_days) for r in facts.period_type(catalog).orderBy("fact_id", "accession").collect()]
    assert kinds == [("1", "duration", 366), ("2", "instant", None), ("3", "duration", 91), ("4", "invalid", None), ("4", "invalid", None)]
    assert {(r.rule, r.key, r.n) for r in facts.violations(catalog).collect()} == {("fact_id is unique", "4", 2), ("accession determines company", "b", 2)}
    seen = {r.concept: (r.fact_count, r.units) for r in facts.observations(catalog).collect()}
    assert seen["us:NetIncomeLoss"] == (2, ["USD"])


def test_units_and_precision():
    assert [mapping.compare_units(*p) for p in (("USD", "USD"), ("x", "x"), ("USD", "USD_million"), ("percent", "percentage_point"), ("USD", "x"))] == ["exact_label_match", "exact_label_match", "registered_equivalence", "dimension_mismatch", "unregistered_unit"]
    assert mapping.in_base("12.5", "percent") == Decimal("0.125")
    q, t, e = mapping.precision_of(1), mapping.precision_of(1, "0.5"), mapping.precision_of()
    d = Decimal
    assert mapping.matches(d("1.2"), d("1.25"), q) and not mapping.matches(d("1.3"), d("1.25"), q) and mapping.matches(d("1.4"), d("1.35"), q)
    assert not mapping.matches(d("1.24"), d("1.2"), q) and mapping.matches(d("1.24"), d("1.2"), q, both=True)
    assert mapping.matches(d("2"), d("2.5"), t) and not mapping.matches(d("2"), d("2.51"), t)
    assert [mapping.compare(d(1), d(x), e) for x in (1, -1, 2)] == ["signed_equivalent", "opposite_sign_magnitude_only", "different"]


def test_mapping_stages(spark):
    targets = spark.createDataFrame([("t1", "X", ["k1"], True), ("t2", "X", ["k9"], True), ("t3", "Y", ["k1"], False)], "target_id string, company string, chunk_ids array<string>, exact_time boolean")
    have = spark.createDataFrame([("f1", "a", "X", "k1", "c", 1.0), ("f2", "b", "X", "k2", "c", 1.0), ("f3", "a", "X", "k3", "c", 2.0)], "fact_id string, accession string, company string, chunk_id string, concept string, value double")
    one = mapping.stage1(targets, have, F.col("value") == 1.0)
    assert [(r.target_id, r.fact_id) for r in one.collect()] == [("t1", "f1")]
    two = mapping.stage2(one, have, ["company", "concept", "value"])
    assert [(r.target_id, r.fact_id, r.parent_id) for r in two.collect()] == [("t1", "f2", "f1")]
    seen = one.select("target_id", "fact_id", F.lit(True).alias("passed")).union(spark.createDataFrame([("t2", "f3", False)], "target_id string, fact_id string, passed boolean"))
    three = mapping.stage3(targets, have, seen, ["company"], F.lit(True))
    assert {(r.target_id, r.fact_id) for r in three.collect()} == {("t2", "f1"), ("t2", "f2")}
    checks = spark.createDataFrame([("t1", "REJECT"), ("t1", "PASS"), ("t2", "UNRESOLVED")], "target_id string, result string")
    searched = spark.createDataFrame([("t3",)], "target_id string")
    assert {r.target_id: r.status for r in mapping.statuses(targets, checks, searched).collect()} == {"t1": "mapped", "t2": "unmappable", "t3": "no_counterpart"}
    twice = one.select("target_id", "fact_id", "stage", F.lit(None).cast("string").alias("parent_id")).union(two.select("target_id", F.lit("f1"), F.lit(2), "parent_id"))
    assert [r.stage for r in mapping.deduped(twice).collect()] == [1]


def test_times(spark):
    t = spark.createDataFrame([("a", "2024"), ("b", None), ("c", None), ("d", None), ("e", None)], "target_id string, exact string")
    c = spark.createDataFrame([("b", "p"), ("b", "p"), ("c", "p"), ("c", "q")], "target_id string, period string")
    s = spark.createDataFrame([("c", "z"), ("d", "z")], "target_id string, period string")
    got = {r.target_id: (r.resolution, r.period) for r in mapping.resolve_time(t, c, s).collect()}
    assert got == {"a": ("exact", "2024"), "b": ("unique_context", "p"), "c": ("ambiguous", None), "d": ("unique_table", "z"), "e": ("unresolved", None)}
    cells = spark.createDataFrame([("t", 1, "p", None), ("t", 1, "q", None), ("t", 2, "p", "p"), ("t", 3, "p", "q"), ("t", 4, "p", None), ("t", 5, None, None), ("t", 6, None, "a"), ("t", 6, None, "b")], "table_id string, col int, period string, linked_period string")
    assert [(r.col, r.state, r.period) for r in mapping.column_periods(cells).orderBy("col").collect()] == [(1, "conflict_column_period", None), (2, "merged", "p"), (3, "conflict_contradiction", None), (4, "derived", "p"), (5, "skipped", None), (6, "conflict_linked_period", None)]


def test_release(spark):
    base = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (3, None, 7)], "k long, s string, n long")
    errata = spark.createDataFrame([(1, "s", "x", "z"), (2, "s", "wrong", "z"), (2, "n", "6", "8"), (3, "k", "3", "4")], "k long, field string, old_value string, new_value string")
    out = mapping.overlay(base, errata, "k", ["s", "n"])
    assert [(r.k, r.s, r.n, r.errors) for r in out.orderBy("k").collect()] == [(1, "z", 5, []), (2, "y", 8, ["old_value:s"]), (3, None, 7, ["not_allowed:k"])]
    new = out.drop("errors").filter("k < 3").union(spark.createDataFrame([(9, "q", 1)], base.schema))
    assert {tuple(r) for r in mapping.diff(base, new, "k", ["s", "n"]).collect()} == {(1, "s", "x", "z"), (2, "n", "6", "8"), (3, "row", "present", "absent"), (9, "row", "absent", "present")}


def test_scoring(spark):
    groups = spark.createDataFrame([(1, "g1", 1), (1, "g2", 2)], "q_id long, group_id string, multiplicity int")
    claims = spark.createDataFrame([(1, 10, "c1"), (1, 20, "c2")], "q_id long, position long, claim string")
    assert [(r.group_id, r.claim) for r in mapping.assigned(claims, groups).orderBy("slot").collect()] == [("g1", "c1"), ("g2", "c2"), ("g2", None)]
    row = spark.createDataFrame([(True, None, False)], "a boolean, b boolean, c boolean")
    assert tuple(row.select(mapping.conjunction(F.col("a"), F.col("b")), mapping.conjunction(F.col("a"), F.col("c")), mapping.conjunction(F.col("b"))).first()) == (True, False, None)
    slots = spark.createDataFrame([("m", "RUN_COMPLETED", 3, 4), ("m", "FAIL_TIMEOUT", 2, 2), ("m", "INFRA_DOWN", 1, 1), ("n", "RUN_COMPLETED", 0, 0)], "metric string, run_status string, numerator long, denominator long")
    got = {r.metric: (r.numerator, r.denominator, r.micro, r.state) for r in mapping.micro(slots, ["metric"]).collect()}
    assert got == {"m": (3, 6, 0.5, "EVAL_INCOMPLETE"), "n": (0, 0, None, "EVAL_COMPLETE")}
    paths = spark.createDataFrame([(1, "p", "x"), (1, "p", "y"), (1, "q", "z"), (2, "p", "x"), (2, "p", "w")], "claim_id long, path_id string, member string")
    cited = spark.createDataFrame([(1, "z"), (2, "x")], "claim_id long, member string")
    assert {r.claim_id: r.matched for r in mapping.paths_matched(paths, cited).collect()} == {1: True, 2: False}


def test_graphs(spark):
    dag = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "parent string, child string")
    assert {tuple(r) for r in graph.leaves(dag).collect()} == {(x, "e") for x in "abcd"}
    assert {r.node: r.level for r in graph.levels(dag).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert graph.cyclic(dag).count() == 0
    loop = dag.union(spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "x")], dag.schema))
    assert {tuple(r) for r in graph.cyclic(loop).collect()} == {("x", "y"), ("y", "x"), ("z", "x")}


def test_exact_values_and_consistency(spark):
    rows = [("1,234.50", 6, None), ("(7)", -2, None), ("0.0", 3, "-"), ("n/a", 0, None), ("123456789012345678901234567890.5", 3, "-"), ("-5", None, None)]
    df = spark.createDataFrame(rows, "raw string, scale int, sign string")
    got = [r.x for r in df.select(facts.exact_value("raw", "scale", "sign").alias("x")).collect()]
    assert got == ["1234500000", "-0.07", "0", None, "-123456789012345678901234567890500", "-5"]
    pair = "cell_value double, cell_scale int, cell_end string, cell_months int, cell_unit string, fact_value double, fact_end string, fact_months int, fact_unit string"
    df = spark.createDataFrame([(1.5, 6, "e", 3, None, 1.5e6, "e", 3, "USD"), (-1.5, 6, "e", 12, "USD", 1.5e6, "f", 3, "shares"), (2.0, None, None, None, None, 3.0, None, None, None)], pair)
    flags = ["magnitude_ok", "sign_ok", "end_ok", "months_ok", "unit_ok", "consistent"]
    assert [tuple(r) for r in facts.consistency(df).select(*flags).collect()] == [(True,) * 6, (True, False, False, False, False, False), (False, True, True, True, True, False)]


def test_running_headers(spark):
    said = ["PART I", "ITEM 1.", "Item 1. Business", "We sell things.", "PART I", "more text here.", "ITEM 2.", "PART II", "RISKS", "Text."]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "doc_id long, position long, text string")
    got = [r.is_heading for r in blocks.suppress_running_headers(df).orderBy("position").collect()]
    assert got == [True, True, True, False, False, False, True, True, True, False]


def test_trace(catalog):
    one = lambda got, **k: facts.trace(catalog, got, k).first()
    got = facts.query(catalog, "us:NetIncomeLoss")
    a, b = one(got, concept="us:NetIncomeLoss", form=None), one(got.repartition(7))
    assert (a.fact_count, a.matched_count, a.filters, b.filters) == (5, 2, '{"concept":"us:NetIncomeLoss"}', "{}") and a.fingerprint == b.fingerprint
    assert len({a.fingerprint, one(got.limit(1)).fingerprint, one(got.limit(0)).fingerprint, one(got.unionByName(got)).fingerprint}) == 4 and one(got.limit(0)).matched_count == 0
