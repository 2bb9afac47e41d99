"""Constraints, loads, ingest, evidence and the evaluator on small hand-made cases."""

import io
import urllib.error
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import blocks, calculator, constraints, dense, evaluator, facts, fusion, ingest, lexical, metrics, provenance, runtime, tables, temporal
from ledgerloom.sources import loads, xbrl
from ledgerloom.sources.html import tree


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lexical_column(spark):
    said = ["ＮＶＩＤＩＡ’s 10‑K: $1,234.50, 39.3%, FY27Q1 / AI/ML.", "a_b x1,234 12,3456 1,234,567.5% 3M 2024's EBITDA2.5%", "Straße ÉTÉ naïve ﬁ ½ İx ſ", "", None, "Ärger–Über/öl's 1,000", "éte Ǆ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    assert {r.i: r.x for r in df.select("i", text.lexical(F.col("t")).alias("x")).collect()} == {i: text.lexical_tokens(t) for i, t in enumerate(said)}
    assert text.lexical_tokens(said[0]) == ["nvidia's", "10-k", "1234.50", "39.3%", "fy27q1", "ai/ml"]


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([("b", "apple carrot"), ("a", "apple apple banana"), ("c", "carrot"), ("d", None)], "doc_id string, text string")
    i = lexical.Index.build(docs, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "apple"), (2, "nothing"), (3, "")], "q_id long, query string")
    got = {r.q_id: (r.n_results, [x.doc_id for x in r.ranked_results]) for r in i.run(q, 5).collect()}
    assert got == {1: (2, ["a", "b"]), 2: (0, []), 3: (0, [])}
    s = i.statistics().first()
    assert (s.n, s.min_dl, s.max_dl, s.vocabulary, s.postings) == (4, 0, 3, 3, 5)
    again = lexical.Index.build(docs.repartition(3), str(tmp_path / "j"))
    assert i.fingerprint() == again.fingerprint() != lexical.Index.build(docs.filter("doc_id <> 'c'"), str(tmp_path / "k")).fingerprint()
    with pytest.raises(ValueError):
        lexical.Index.build(docs, str(tmp_path / "l"), b=2)


def test_constraints(spark):
    d = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (2, None, 6)], "k int, v string, f int")
    p = spark.createDataFrame([(5,)], "f int")
    assert rows(constraints.unique(d, ["k"], "u")) == [("u", "1", 2)] and rows(constraints.determines(d, ["k"], "v", "d")) == [("d", "1", 2)]
    assert rows(constraints.refers(d, "f", p, "f", "r")) == [("r", "6", 1)] and rows(constraints.holds(d, ["k"], F.col("v") == "a", "h")) == [("h", "1", 1), ("h", "2", 1)]
    with pytest.raises(constraints.Broken, match="u: 1"):
        constraints.require(constraints.unique(d, ["k"], "u"))


def test_zero_vectors_and_rerank_checks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    assert rows(dense.cosine(v, q, 5).select("q_id", "vec_id", "rank")) == [(1, 1, 1), (1, 3, 2), (3, 1, 2), (3, 3, 1)]
    a = spark.createDataFrame([(1, "x", "f"), (2, "y", "f"), (3, "z", "f")], "q_id int, query string, corpus_fingerprint string")
    b = spark.createDataFrame([(1, "x", "f"), (2, "other", "g")], "q_id int, query string, corpus_fingerprint string")
    assert rows(fusion.pair_defects(a, b)) == [(2, "corpus"), (2, "query"), (3, "one_side")]
    u = spark.createDataFrame([(1, 7), (1, 8)], "q_id int, doc_id int")
    ranked, lost = fusion.with_audit_ranks(u, spark.createDataFrame([(1, 7, 2), (1, 9, 1)], "q_id int, doc_id int, rank int"))
    assert rows(ranked.select("doc_id", "audit_rank")) == [(7, 2), (8, None)] and rows(lost.select("doc_id")) == [(9,)]
    n = fusion.length_summary(spark.createDataFrame([(3,), (9,), (10,)], "l int"), "l", 9).first()
    assert (n.n, n.low, n.median, n.high, round(n.truncated_share, 3)) == (3, 3, 9.0, 10, 0.333)


def test_scoring(spark):
    gold = spark.createDataFrame([("q", 1, 1, "core", "a"), ("q", 1, 2, "core", "b"), ("q", 2, 1, "core", "c")], "q_id string, item_id int, part_id int, importance string, key string")
    r = spark.createDataFrame([("s", "q", 1, "a"), ("s", "q", 2, "c"), ("s", "q", 3, "b")], "system string, q_id string, rank int, key string")
    out = {k: {x.k: x for x in v.collect()} for k, v in metrics.scored(r, gold, F.col("item_id")).items() if k in ("evidence", "numeric")}
    assert (out["numeric"][1].strict_fact_coverage, out["numeric"][1].multi_input_strict_rate, out["numeric"][1].mean_input_coverage) == (0.0, 0.0, 0.5)
    assert (out["numeric"][3].multi_input_strict_rate, out["numeric"][3].complete_question_rate, out["evidence"][3].part_recall) == (1.0, 1.0, 1.0)
    with pytest.raises(ValueError, match="malformed"):
        metrics.scored(r.filter("rank <> 2"), gold, F.col("item_id"))
    first = metrics.first_ranks(r, gold)
    inputs = spark.createDataFrame([("q", 2, 1), ("q", 2, 2)], "q_id string, item_id int, input_id int")
    assert rows(metrics.derived_ranks(first, inputs).filter("item_id = 2").select("part_id", "first_rank")) == [("1/1", 1), ("1/2", 3), ("2/1", 2)]


TABLE = """<table><tr><td colspan=3>Segment revenue (unaudited)</td></tr><tr><td colspan=3>(in millions)</td></tr><tr><td></td><td colspan=2>Three months ended March 31, 2024</td></tr>
<tr><td>Cloud (1)</td><td>1,200</td><td><ix:nonfraction id="f1" name="us:Rev">1,300</ix:nonfraction></td></tr><tr><td>Staff</td><td>12</td><td>7</td></tr>
<tr><td></td><td colspan=2>Three months ended June 30, 2024</td></tr><tr><td>Cloud (1)</td><td>1,500</td><td>1,600</td></tr></table>"""


def test_table_bands_and_metadata_rows():
    t = tables.assembled(tree(TABLE).all("table")[0])
    assert t["scale"] == 6 and t["caption"] == "Segment revenue (unaudited)" and len(t["bands"]) == 2
    by = {(c["label"], c["raw_text"]): c for c in t["cells"]}
    assert str(by[("Cloud (1)", "1,200")]["period_end"]) == "2024-03-31" and str(by[("Cloud (1)", "1,600")]["period_end"]) == "2024-06-30"
    assert by[("Cloud (1)", "1,300")]["fact_ids"] == ["f1"] and ("Staff", "12") in by and by[("Cloud (1)", "1,500")]["footnotes"] == ["1"]
    small = tables.assembled(tree("<table><tr><td>Year</td><td>2024</td></tr><tr><td>Staff</td><td>12</td></tr></table>").all("table")[0])
    assert [c["raw_text"] for c in small["cells"]] == ["12"]


PAGE = f"""<html><head><title>x</title></head><body><div><p>PART I</p><p><b>ITEM 1.</b></p><p style="font-weight:700">Overview</p><p>Text one with <ix:nonfraction id="f2" name="us:A" contextref="c" unitref="u">5</ix:nonfraction>.</p>loose words<p>Item 2. Results</p>{TABLE}<p>After.</p></div></body></html>"""


def test_ingest(spark):
    pages = spark.createDataFrame([("d1", PAGE), ("d2", None)], "doc_id string, html string")
    out = ingest.ingest(pages, root=F.when(F.col("doc_id") == "d1", F.lit("Exhibit 99")))
    got = [(r.block_type, r.text.split("\n")[0][:12], r.section_path, r.fact_ids) for r in out["blocks"].orderBy("doc_id", "position").collect()]
    assert [g[0] for g in got] == ["heading", "heading", "heading", "paragraph", "paragraph", "heading", "table", "paragraph"]
    assert got[3][2] == ["Exhibit 99", "PART I", "ITEM 1.", "Overview"] and got[3][3] == ["f2"] and got[6][3] == ["f1"]
    chunks = out["chunks"].orderBy("chunk_no").collect()
    assert [c.block_type for c in chunks].count("table") == 1 and chunks[0].next_chunk_id == chunks[1].chunk_id
    text_chunk = next(c for c in chunks if "loose words" in c.text)
    assert text_chunk.text.startswith("Overview\n\nText one") and text_chunk.retrieval_text.startswith("Exhibit 99 > PART I") and text_chunk.fact_ids == ["f2"]
    s = out["summary"].first()
    assert (s.documents, s.blocks, s.tables, s.facts, s.period_cells) == (2, 8, 1, 2, 6) and s.chunks == len(chunks)


def test_chunk_groups():
    assert blocks.chunk_groups([300, 300, 300, 5, 10, 10], ["paragraph", "paragraph", "paragraph", "table", "paragraph", "paragraph"], ["s"] * 6) == [0, 0, 1, 2, 3, 3]
    assert blocks.chunk_groups([1, 1, 1, 1], ["heading", "paragraph", "heading", "paragraph"], ["a", "a", "b", "c"]) == [0, 0, 1, 2]


def test_loads(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "d1", "x", "old"), ("c2", "d2", "y", "old")], "chunk_id string, doc_id string, text string, company string")
    manifest = spark.createDataFrame([("d1", "ACME", "h1"), ("d2", "Beta", "h2")], "doc_id string, company string, chunk_sha256 string")
    assert rows(loads.corpus(chunks, manifest, loads.corpus_identity(manifest)).select("chunk_id", "company")) == [("c1", "ACME"), ("c2", "Beta")]
    for bad in (lambda: loads.corpus(chunks.unionByName(chunks), manifest), lambda: loads.corpus(chunks, manifest.filter("doc_id = 'd1'")), lambda: loads.corpus(chunks, manifest, "other")):
        with pytest.raises(constraints.Broken):
            bad()
    assert loads.lookup(manifest, "doc_id", "d1")["company"] == "ACME"
    with pytest.raises(KeyError):
        loads.lookup(manifest, "doc_id", "d9")
    (tmp_path / "q.csv").write_text("q_id,query_en\n1,what\n2,who\n")
    assert loads.queries(spark, str(tmp_path / "q.csv"), 2).count() == 2
    (tmp_path / "r.csv").write_text("q_id,query_en\n1,what\n1,who\n")
    with pytest.raises(constraints.Broken):
        loads.queries(spark, str(tmp_path / "r.csv"))
    hashes = loads.write_artifacts(chunks, str(tmp_path / "out"))
    assert rows(loads.write_artifacts(chunks.repartition(2), str(tmp_path / "out"), expected=hashes)) == rows(hashes)
    with pytest.raises(constraints.Broken):
        loads.write_artifacts(chunks.withColumn("text", F.lit("z")), str(tmp_path / "out"), expected=hashes)


def test_gold_bundle(spark):
    q = spark.createDataFrame([("q1", "why", "a1;a2")], "q_id string, question string, allowed_accessions string")
    a = spark.createDataFrame([("q1", "f1", "5", "USD", ""), ("q1", "f2", "6", "USD", ""), ("q1", "f3", "11", "USD", "f1;f2")], "q_id string, fact_id string, value string, unit string, input_fact_ids string")
    e = spark.createDataFrame([("q1", "i1", "core", "c1;c2")], "q_id string, item_id string, importance string, chunk_ids string")
    m = spark.createDataFrame([("a1",), ("a2",)], "accession string")
    r = loads.gold_bundle(q, a, e, m).first()
    assert r.allowed_accessions == ["a1", "a2"] and r.answers[2].inputs == ["f1", "f2"] and r.evidence[0].weight == 3.0
    for bad in (e.withColumn("chunk_ids", F.lit("c1;;c2")), e.withColumn("chunk_ids", F.lit("c1;c1")), e.withColumn("importance", F.lit("vital"))):
        with pytest.raises(constraints.Broken):
            loads.gold_bundle(q, a, bad, m)


def test_fetcher():
    waits, answers = [], [urllib.error.HTTPError("u", 429, "", {}, None), urllib.error.URLError("x"), io.BytesIO(b"body")]

    def opened(request):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        x.headers = {"Content-Type": "text/html"}
        return x

    assert loads.Fetcher("me", opened, waits.append, lambda: 0.0).get("http://u") == (b"body", "text/html")
    assert waits == [1.5, 0.25, 3.0, 0.25]
    answers[:] = [urllib.error.HTTPError("u", 404, "", {}, None)]
    with pytest.raises(urllib.error.HTTPError):
        loads.Fetcher("me", opened, waits.append).get("http://u")


def test_provenance_assembly(spark):
    wanted = spark.createDataFrame([("q", "f1", False), ("q", "f2", False), ("q", "d", True), ("q", "e", True), ("q", "x", False)], "q_id string, fact_id string, derived boolean")
    by = lambda *r: spark.createDataFrame(list(r), "fact_id string, chunk_id string")
    inputs = spark.createDataFrame([("d", "f1"), ("d", "f2"), ("e", "f1"), ("e", "x")], "fact_id string, input_id string")
    got = {r.fact_id: (r.status, r.chunk_ids) for r in provenance.numeric_provenance(wanted, by(("f1", "c9")), by(("f1", "c1"), ("f2", "c2"), ("f2", "c9")), by(("f2", "c5")), inputs).collect()}
    assert got == {"f1": ("direct_unique", ["c9"]), "f2": ("direct_or", ["c2", "c9"]), "d": ("derived", ["c9", "c2"]), "e": ("inputs_missing", ["c9"]), "x": ("missing", [])}
    atoms = spark.createDataFrame([("i", "a", "c1"), ("i", "b", "c1"), ("i", "z", "c2"), ("j", "a", "c1"), ("j", "b", "c2")], "item_id string, atom_id string, chunk_id string")
    groups = spark.createDataFrame([("i", "a", "p"), ("i", "b", "p"), ("j", "a", "p"), ("j", "b", "p")], "item_id string, atom_id string, part_id string")
    parts, bad = provenance.part_groups(atoms, groups)
    assert rows(parts) == [("i", "p", ["c1"]), ("i", "z", ["c2"])] and rows(bad.select("key")) == [("j-p",)]
    items = spark.createDataFrame([("q", "i", "core")], "q_id string, item_id string, importance string")
    src = spark.createDataFrame([("c1", "a1"), ("c2", "a2")], "chunk_id string, accession string")
    out, bad = provenance.evidence(parts, items, src, spark.createDataFrame([("q", "a1")], "q_id string, accession string"))
    assert [p.part_id for p in out.first().parts] == ["p"] and rows(bad.select("key")) == [("q-c2",)]
    found = spark.createDataFrame([("c1", "L2", "fox"), ("c1", "L1", "none")], "chunk_id string, label string, needle string")
    a = provenance.anchors(found, spark.createDataFrame([("c1", "d1", "x" * 2000 + "fox")], "chunk_id string, doc_id string, text string"), spark.createDataFrame([("d1", "a1")], "doc_id string, accession string")).first()
    assert a.labels == ["L1", "L2"] and a.excerpt.endswith("fox") and len(a.anchor_id) == 28 and a.accession == "a1"
    v = spark.createDataFrame([(1, "d", -5.0, 6, "rev"), (2, "d", 7.0, None, None)], "value_id int, doc_id string, value double, exponent int, tag string")
    f = spark.createDataFrame([("d", "f1", "us:Revenue", 5e6), ("d", "f2", "us:Cost", 5e6), ("d", "f3", "us:X", 7.0)], "doc_id string, fact_id string, concept string, scaled double")
    assert rows(provenance.match_xbrl(v, f).select("value_id", "fact_id")) == [(1, "f1"), (2, "f3")]
    m = spark.createDataFrame([(1, "h"), (2, "h"), (3, "h")], "k int, content_hash string")
    ok, bad = provenance.finalised(m, spark.createDataFrame([(1, "approved", "h"), (2, "approved", "g")], "k int, decision string, content_hash string"), ["k"])
    assert rows(ok.select("k")) == [(1,)] and rows(bad.select("rule", "key")) == [("decided on other content", "2"), ("no decision", "3")]


def test_findings(spark):
    blank = {k: None for k in evaluator.IDENTITY}
    cite = lambda i, kind, **k: {"owner_id": "o", "record_index": i, "kind": kind, "chunk_id": None, "locator": None, "fact_locator": None} | blank | k
    text = "owner_id string, record_index int, kind string, chunk_id string, locator string, fact_locator string, " + ", ".join(f"{k} string" for k in evaluator.IDENTITY)
    order = [x.split()[0] for x in text.split(", ")]
    same = {"accession": "a", "concept": "c", "context_ref": "x", "unit": "USD", "instant": "2024-01-01"}
    cited = [cite(0, "chunk", chunk_id="c1", accession="a", locator="l"), cite(1, "chunk", chunk_id="no", accession="a"), cite(2, "chunk", chunk_id="c1", accession="b", locator="m"), cite(3, "xbrl_fact", fact_locator="f", **same), cite(4, "xbrl_fact", fact_locator="f", **(same | {"unit": "EUR"})), cite(5, "xbrl_fact", fact_locator="g", **same)]
    chunks = spark.createDataFrame([("c1", "a", "l", True)], "chunk_id string, accession string, locator string, allowed boolean")
    fs = spark.createDataFrame([("f", "c1", 5.0, "a", "c", "x", "USD", "2024-01-01", None, None)], "fact_locator string, chunk_id string, value double, " + ", ".join(f"{k} string" for k in evaluator.IDENTITY))
    got = {r.record_index: (r.reason_codes, r.identity_valid, r.hallucinated) for r in evaluator.findings(spark.createDataFrame([tuple(c[k] for k in order) for c in cited], text), chunks, fs).collect()}
    assert got == {0: ([], True, False), 1: (["nonexistent_chunk_id"], False, True), 2: (["metadata_inconsistent", "wrong_accession"], False, True), 3: ([], True, False), 4: (["wrong_fact_identity"], False, False), 5: (["nonexistent_fact_locator"], False, True)}


def test_derived_claims():
    exact = {"mode": "EXACT"}
    targets = {"rev": {"value": "100", "unit": "USD", "precision": exact}, "cost": {"value": "60", "unit": "USD", "precision": exact}, "profit": {"value": "40", "unit": "USD", "precision": exact}, "margin": {"value": "0.4", "unit": "pure", "precision": exact}}
    specs = {"profit": [{"inputs": [{"role": "r", "target": "rev"}, {"role": "c", "target": "cost"}], "formulas": ["r - c"], "unit": "USD", "value": "40", "precision": exact}], "margin": [{"inputs": [{"role": "p", "target": "profit"}, {"role": "r", "target": "rev"}], "formulas": ["p / r"], "unit": "pure", "value": "0.4", "precision": {"mode": "QUANTUM", "quantum": Decimal("0.1")}}]}
    item = lambda i, name, value, unit="USD", calc=None: {"input_id": i, "name": name, "value": value, "unit": unit, "calculation": calc, "fact": calc is None}
    calcs = {
        "m": {"expression": "x / y", "inputs": [item("x", "p", "40", calc="k"), item("y", "r", "100")], "result": {"value": "0.4", "unit": "pure"}},
        "k": {"expression": "a - b", "inputs": [item("a", "a", "100"), item("b", "b", "60")], "result": {"value": "40", "unit": "USD"}},
        "wrong": {"expression": "a - b", "inputs": [item("a", "a", "60"), item("b", "b", "100")], "result": {"value": "-40", "unit": "USD"}},
        "same": {"expression": "a", "inputs": [item("a", "a", "100")], "result": {"value": "100", "unit": "USD"}},
        "loop": {"expression": "a", "inputs": [item("a", "a", "100", calc="loop")], "result": {"value": "100", "unit": "USD"}},
    }
    out = evaluator.derived(calcs, specs, targets, lambda k, i, t: True)
    assert out[("m", "margin")]["complete"] and out[("k", "profit")]["complete"] and out[("same", "rev")]["complete"]
    assert not out[("wrong", "profit")]["complete"] and out[("wrong", "profit")]["arithmetic"] and not out[("loop", "rev")]["complete"] and not out[("k", "rev")]["complete"]
    uncited = evaluator.derived(calcs, specs, targets, lambda k, i, t: (k, i) != ("k", "b"))
    assert not uncited[("m", "margin")]["complete"] and not uncited[("k", "profit")]["path"] and uncited[("k", "profit")]["formula"]
    deep = {f"c{n}": {"expression": "a", "inputs": [item("a", "a", "100", calc=f"c{n - 1}" if n else None)], "result": {"value": "100", "unit": "USD"}} for n in range(3000)}
    assert evaluator.derived(deep, {}, {"rev": targets["rev"]}, lambda k, i, t: True)[("c2999", "rev")]["complete"]
    bad = evaluator.self_consistent([{"id": 1, "formula": "a + b", "inputs": {"a": "1", "b": "2"}, "value": "3", "precision": exact}, {"id": 2, "formula": "a / b", "inputs": {"a": "1", "b": "0"}, "value": "3", "precision": exact}])
    assert [b["id"] for b in bad] == [2]


def test_index_report(spark):
    f = spark.createDataFrame([("f1", "a", "x", "ACME", "c1", "2024-01-01", None, None), ("f1", "a", "x", "ACME", "c9", None, "2024-02-01", "2024-01-01")], "fact_locator string, accession string, context_ref string, company string, chunk_id string, instant string, period_start string, period_end string")
    chunks = spark.createDataFrame([("c1",)], "chunk_id string")
    assert {r.rule for r in evaluator.index_report(f, chunks).collect()} == {"a locator is one fact", "a context has one period", "a fact's chunk exists", "an instant or a period"}
    t = spark.createDataFrame([("t1", "g", "5"), ("t2", "g", "no")], "target_id string, group_id string, value string")
    m = spark.createDataFrame([("t1", "p", "c9", "f1")], "target_id string, path_id string, chunk_id string, fact_locator string")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert {r.rule for r in evaluator.gold_report(t, m, f, chunks).collect()} == {"a target has a value", "a target has a path", "a path's chunk exists"}
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_tools(spark):
    f = spark.createDataFrame([("f1", "acc", "us:Revenue", "ACME", "10-K", "USD", "5", "2024-01-01", "2024-12-31", None)], "fact_id string, accession string, concept string, company string, form string, unit string, value string, period_start string, period_end string, instant string")
    f = f.withColumns({c: F.to_date(c) for c in ("period_start", "period_end", "instant")})

    def search(q, k):
        if q == "boom":
            raise TypeError("a tool's own fault")
        return [{"n": i} for i in range(3)]

    r = runtime.standard(spark, search, f)
    assert [(s["tool"], s["operation"]) for s in r.specs()] == [("calculator", "calculate"), ("retrieval", "search"), ("xbrl", "query"), ("xbrl", "search")]
    ok = r.invoke("c1", "xbrl", "query", {"concept": "us:Revenue", "filters": {"company": "ACME"}, "include_dimensions": False})
    got = ok["result"]["facts"][0]
    assert list(got) == list(facts.PUBLIC_FIELDS) and len(got) == 37 and got["duration_days"] == 366 and got["normalized_value"] == "5" and got["dimensions"] is None and ok["result"]["trace"]["matched_count"] == 1
    assert r.invoke("c2", "retrieval", "search", {"query": " x ", "top_k": 3})["status"] == "ok"
    kinds = [r.invoke(f"e{i}", *a)["error"]["kind"] for i, a in enumerate([("retrieval", "search", {"query": "x", "top_k": 9}), ("retrieval", "search", {"query": "boom"}), ("xbrl", "query", {"concept": "us:No"}), ("xbrl", "write", {}), ("calculator", "calculate", {"expression": "a/b", "inputs": {"a": {"value": "1"}, "b": {"value": "0"}}}), ("calculator", "calculate", {"expression": "a", "inputs": {"a": {"value": 1}}})])]
    assert kinds == ["too_few_results", "tool_failure", "input", "unknown_operation", "input", "input"] and len(r.ledger) == 8
    out = r.invoke("c9", "calculator", "calculate", {"expression": "a * 2", "inputs": {"a": {"value": "1.50", "unit": "USD"}}, "result_metadata": {"n": [1, None]}})["result"]
    assert out["result"] == "3" and out["inputs"][0]["canonical_value"] == "1.5" and out["result_metadata"] == {"n": [1, None]}
    loop = []
    loop.append(loop)
    for bad in (1.5, {"a": object()}, loop, {1: 2}):
        with pytest.raises(calculator.CalculatorError):
            calculator.checked_metadata(bad)


def test_temporal(spark):
    r = spark.createDataFrame([("A", "x", "c1", "2024-01-01", "2024-03-31", 5), ("A", "y", "c1", "2024-01-01", "2024-03-31", 5), ("A", "x", "c2", "2024-01-01", "2024-03-31", 5), ("A", "x", "c1", "2023-12-01", "2024-03-31", 5)], "company string, accession string, concept string, period_start string, period_end string, value int")
    for by in ([], ["company"]):
        got = temporal.pseudo_targets(r, by, ["accession", "concept", "period_start"]).collect()
        assert sorted(x.kind for x in got) == ["across_concepts", "across_filings", "same_end"]
    pair = next(x for x in got if x.kind == "same_end")
    assert (pair.first_period_start, pair.second_period_start, pair.first_concept) == ("2023-12-01", "2024-01-01", "c1")
    n = temporal.counters(spark.createDataFrame([("instant", 1), ("duration", 0), ("duration", 2)], "period_type string, n_dimensions int")).first()
    assert (n.n_rows, n.instant, n.duration, n.invalid, n.dimensional) == (3, 1, 2, 0, 2)
    f = spark.createDataFrame([("d", ["f1", "f2"], "c1"), ("d", ["f2"], "c2")], "doc_id string, fact_ids array<string>, chunk_id string")
    links, bad = facts.chunk_links(f)
    assert rows(links) == [("d", "f1", "c1")] and rows(bad.select("key")) == [("d-f2",)]


def test_one_parse_for_a_page(spark):
    pages = spark.createDataFrame([("d1", PAGE), ("d2", None), ("d3", ""), ("d4", "<table><tr><td><table><tr><td>Inner</td><td>1,000</td></tr></table></td></tr></table>")], "doc_id string, html string")
    own = ingest.parsed(pages)
    assert own._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    kinds = {(r.doc_id, r.kind): r.n for r in own.groupBy("doc_id", "kind").agg(F.count("*").alias("n")).collect()}
    assert kinds[("d1", "block")] == 8 and kinds[("d1", "fact")] == 2 and kinds[("d4", "block")] == 1 and not {d for d, _ in kinds} & {"d2", "d3"}
    same = lambda a, b, key: rows(a.select(*b.columns).orderBy(key, "row", "col")) == rows(b.orderBy(key, "row", "col"))
    assert same(ingest.part(own, "cell"), tables.cells(pages, "doc_id"), "doc_id")
    assert sorted(map(str, rows(ingest.facts_of(own)))) == sorted(map(str, rows(xbrl.facts(pages))))
    ingest.register(spark)
    pages.createOrReplaceTempView("some_pages")
    assert spark.sql("SELECT doc_id, b.block.text FROM some_pages, LATERAL parse_page(html) b WHERE b.kind = 'block'").count() == 9


def test_sections_end_each_other(spark):
    said = ["Item 1. A", "Sub", "Note 1 X", "Other", "Item 2. B", "text", "Part II", "Note 2 Y", "Item 3. C"]
    given = spark.createDataFrame([(1, i, "paragraph" if t == "text" else "heading", t) for i, t in enumerate(said)], "doc_id int, position long, block_type string, text string")
    got = [r.section_path for r in ingest.sectioned(given).orderBy("position").collect()]
    assert got == [["Item 1. A"], ["Item 1. A", "Sub"], ["Item 1. A", "Note 1 X"], ["Item 1. A", "Other"], ["Item 2. B"], ["Item 2. B"], ["Part II"], ["Part II", "Note 2 Y"], ["Part II", "Item 3. C"]]


@pytest.mark.parametrize("text, inside", [("a * (1 - b) * (1 + b)", True), ("-a + b - 0.25", True), ("-(a - a)", True), ("a * b * a * b", False), ("a / 4", False), ("+a * 1000", True), ("a - 0.0000001", False)])
def test_decimals_inside_spark(spark, text, inside):
    given = [(Decimal(a), Decimal(b)) for a in ("0.00", "-0.01", "9999999999.99", "-9999999999.99", "100.00", "7.10") for b in ("0.00", "0.05", "-9999999999.99", "9999999999.99")] + [(None, Decimal("1.00"))]
    df = spark.createDataFrame(given, "a decimal(12,2), b decimal(12,2)")
    cols = {k: F.col(k) for k in calculator.names(calculator.parse(text))}
    got = df.select("a", "b", calculator.calculated(text, cols, dict.fromkeys(cols, (12, 2))).alias("x"))
    assert ("Python" not in got._jdf.queryExecution().executedPlan().toString()) == inside
    for r in got.collect():
        known = {k: str(r[k]) for k in cols}
        assert r.x == (None if "None" in known.values() else calculator.evaluate(text, known))
