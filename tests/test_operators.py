"""Operators on small hand-made cases."""

import itertools
import math
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text
from ledgerloom.operators import blocks, calculator, dense, fusion, lexical, metrics, provenance, runtime
from ledgerloom.sources import canonical


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("said, tokens", [("Net sales rose 1,234.5% in Q3", ["net", "sales", "rose", "1234.5%", "in", "q3"]), ("year‑over‑year and/or Apple’s ﬁscal", ["year-over-year", "and/or", "apple's", "fiscal"]), ("Straße 12,00", ["strasse", "12", "00"]), ("", [])])
def test_lexical_tokens(said, tokens):
    assert text.lexical_tokens(said) == tokens


@pytest.mark.parametrize("raw, value, percent, negative", [("$1,234.50", 1234.5, False, False), ("(5.2%)", -5.2, True, True), ("-7", -7.0, False, True), ("n/a", None, False, False), ("3.1 pp", 3.1, False, False), ("12.", None, False, False)])
def test_numbers(spark, raw, value, percent, negative):
    got = one(spark, text.parsed_number(F.col("r")), r=raw)
    assert (got.value, got.is_percent, got.is_negative) == (value, percent, negative)


def test_scales_and_durations(spark):
    assert [one(spark, text.unit_scale(F.col("t")), t=t) for t in ("in Millions", "thousand of billions", "USD")] == [6, 9, None]
    assert [one(spark, text.phrase_months(F.col("t")), t=t) for t in ("Nine Months Ended", "Year ended", "as of")] == [9, 12, None]
    months = lambda a, b: one(spark, text.duration_months(F.to_date("a"), F.to_date("b")), a=a, b=b)
    assert [months("2024-01-01", "2024-12-31"), months("2024-01-01", "2024-03-31"), months("2024-01-01", "2024-01-01"), months("2024-02-01", "2024-01-01")] == [12, 3, 1, None]
    assert one(spark, text.name_tokens(F.col("n")), n="RevenueFromContract2Customer") == ["revenue", "from", "contract2", "customer"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "apple banana apple"), ("b", "banana"), ("c", ""), ("d", "cherry apple")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "Apple apple pear")], "q_id long, query string")
    got = {r.doc_id: (r.score, r["rank"]) for r in lexical.bm25(docs, q).collect()}
    idf, avg = math.log1p((4 - 2 + 0.5) / 2.5), 6 / 4
    part = lambda tf, dl: round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)), 6)
    assert got == {"a": (part(2, 3), 1), "d": (part(1, 2), 2)}
    assert [r.doc_id for r in lexical.bm25(docs, q, where=F.col("doc_id") == "d").collect()] == ["d"]


def test_cosine_and_blocks_of_queries(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i % 5)]) for i in range(40)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id < 6").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    whole = dense.cosine(v, q, 5).orderBy("q_id", "rank").collect()
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    assert dense.cosine(v, q, 5).orderBy("q_id", "rank").collect() == whole
    assert all(r.score == 1.0 for r in whole if r["rank"] == 1)


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1, 9.0), (1, "y", 2, 8.0)], "q_id long, doc_id string, rank int, score double")
    b = spark.createDataFrame([(1, "y", 1, 0.5), (1, "z", 2, 0.4)], "q_id long, doc_id string, rank int, score double")
    got = [(r.doc_id, r.score) for r in fusion.rrf(a, b).orderBy("rank").collect()]
    assert got == [("y", round(1 / 61 + 1 / 62, 9)), ("x", round(1 / 61, 9)), ("z", round(1 / 62, 9))]
    assert fusion.overlap(fusion.candidate_union(a, b)).first()[1:5] == (3, 1, 1, 1)
    assert fusion.rank_defects(a.union(a.filter("rank = 2")), 50).first().ok is False
    left = spark.createDataFrame([(1, "p", None), (2, "q", "r")], "k long, m string, n string")
    right = spark.createDataFrame([(1, "p", "s"), (2, "t", "r")], "k long, m string, n string")
    assert [(r.k, r.n, r.conflicts) for r in fusion.merged_metadata(left, right, "k", ["m", "n"]).orderBy("k").collect()] == [(1, "s", []), (2, "r", ["m"])]


def test_and_or_metrics(spark):
    gold = spark.createDataFrame([(1, 1, 1, "core", "a"), (1, 1, 1, "core", "b"), (1, 1, 2, "core", "c"), (1, 2, 1, "optional", "z")], "q_id long, item_id long, part_id long, importance string, key string")
    ranks = spark.createDataFrame([("s", 1, "x", 1), ("s", 1, "b", 2), ("s", 1, "c", 4)], "system string, q_id long, key string, rank int")
    first = metrics.first_ranks(ranks, gold)
    assert {(r.item_id, r.part_id): r.first_rank for r in first.collect()} == {(1, 1): 2, (1, 2): 4, (2, 1): None}
    got = {r.k: r for r in metrics.evidence_metrics(first).collect()}
    assert (got[3].part_recall, got[3].all_parts_rate, got[3].weighted_partial) == (round(1 / 3, 9), 0.0, round(1.5 / 3.5, 9))
    assert (got[5].all_parts_rate, got[5].weighted_strict, got[5].core_recall, got[5].zero_hit_items) == (0.5, round(3 / 3.5, 9), 1.0, 1)
    assert metrics.mrr(first).first().part_mrr == round((1 / 2 + 1 / 4) / 3, 9)
    missed = {(r.item_id, r.k): r.labels for r in metrics.misses(first, (3,)).collect()}
    assert missed == {(1, 3): "partial_hit;below_k", (2, 3): "not_retrieved"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 6), min_size=1, max_size=4), min_size=1, max_size=5))
def test_smallest_hitting_set(parts):
    got = provenance.smallest_hitting_set([set(p) for p in parts])
    assert all(set(got) & p for p in parts)
    pool = sorted(set().union(*parts))
    assert not any(all(set(c) & p for p in parts) for c in itertools.combinations(pool, len(got) - 1))


def test_no_hitting_set():
    assert provenance.smallest_hitting_set([{1}, set()]) is None


def test_passages_cut_at_words(spark):
    docs = spark.createDataFrame([(1, "xx The quick brown fox jumpsover"), (2, "quick brown"), (3, "no")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "he quick brown fox jumps"), (2, "brown"), (3, "row"), (4, None)], "item_id long, text string")
    assert {tuple(r) for r in provenance.passages_in(docs, asked).select("item_id", "doc_id").collect()} == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)}


@pytest.mark.parametrize("expr, bound, result", [("a / b", {"a": "1", "b": "3"}, "0." + "3" * 50), ("-(a - 2.50) * 4", {"a": "0.5"}, "8"), ("a + +b", {"a": "0.1", "b": "0.2"}, "0.3"), ("2 * (a)", {"a": "-0"}, "0")])
def test_calculator(expr, bound, result):
    assert calculator.evaluate(expr, bound) == result


@pytest.mark.parametrize("expr, bound", [("a ** 2", {"a": "1"}), ("a // 2", {"a": "1"}), ("1 + 2", {}), ("a", {}), ("a", {"a": "1", "b": "2"}), ("a / 0", {"a": "1"}), ("f(a)", {"a": "1"}), ("(a", {"a": "1"}), ("a)", {"a": "1"}), ("", {}), ("a < 2", {"a": "1"}), ("a" + "+a" * 300, {"a": "1"}), ("-" * 40 + "a", {"a": "1"}), ("a" * 2000, {"a": "1"}), ("a", {"a": "x"})])
def test_calculator_refuses(expr, bound):
    with pytest.raises(calculator.CalculatorError):
        calculator.evaluate(expr, bound)


def test_calculator_trees(spark):
    assert calculator.rendered(calculator.parse("a+b*-2.50")) == "(a + (b * (-2.5)))"
    assert calculator.same_formula("a + +b", "x + y", {"x": "a", "y": "b"}) and not calculator.same_formula("a - b", "b - a")
    r = random.Random(1)
    for _ in range(30):
        expr = "".join(r.choice(["a", "b", "3"]) + r.choice("+-*") for _ in range(5)) + "a+b"
        a, b = r.randint(-9, 9), r.randint(-9, 9)
        assert Decimal(calculator.evaluate(expr, {"a": str(a), "b": str(b)})) == eval(expr)
    got = one(spark, calculator.compiled("a / (b - 2) * 3", {"a": F.col("a"), "b": F.col("b")}), a=1.0, b=2.0)
    assert got is None and one(spark, calculator.compiled("a / b", {"a": F.col("a"), "b": F.col("b")}), a=1.0, b=4.0) == 0.25


def test_registry():
    r = runtime.Registry()
    r.register(runtime.Operation("t", "add", lambda a, b: a + b, {"a": {"type": "integer", "required": True, "minimum": 0}, "b": {"type": "integer", "default": 2}}))
    assert r.invoke("x1", "t", "add", {"a": 1})["result"] == 3
    kinds = [r.invoke(f"y{i}", *call)["error"]["kind"] for i, call in enumerate([("t", "add", {}), ("t", "add", {"a": -1}), ("t", "add", {"a": True}), ("t", "add", {"a": 1, "c": 1}), ("t", "sub", {}), ("u", "add", {})])]
    assert kinds == ["input"] * 4 + ["unknown_operation", "unknown_tool"]
    with pytest.raises(runtime.ToolError):
        r.invoke("x1", "t", "add", {"a": 1})
    with pytest.raises(runtime.ToolError):
        r.invoke("1x", "t", "add", {"a": 1})
    assert [e["position"] for e in r.ledger] == list(range(7)) and len({e["hash"] for e in r.ledger}) == 7


def test_page_blocks(spark):
    html = "<html><head><title> A  b</title><style>p{}</style></head><body><h1>Head</h1><p>one <b>two</b><p>three<br>four<script>var t='</p>';</script><table><tr><td>5</td><td>6</td></tr></table><li>last"
    got = blocks.page_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("position").collect()
    assert [(r.block_type, r.text) for r in got] == [("heading", "Head"), ("paragraph", "one two"), ("paragraph", "three"), ("paragraph", "four"), ("cell", "5"), ("cell", "6"), ("paragraph", "last")]
    assert got[0].title == "A b" and got[1].char_start == 5 and got[1].char_end == 12


def test_paragraphs_sections_and_chunks(spark):
    docs = spark.createDataFrame([(1, "PART I\nitem 2. x\nbody one two\nNote 3 y\nz\nPart II\nend"), (2, None)], "doc_id long, text string")
    p = blocks.paragraphs(docs)
    out = blocks.outline(p).filter("doc_id = 1").orderBy("position").collect()
    assert [r.path for r in out] == ["PART I", "PART I > item 2. x", "PART I > item 2. x", "PART I > item 2. x > Note 3 y", "PART I > item 2. x > Note 3 y", "Part II", "Part II"]
    assert [(r.char_start, r.char_end) for r in out][:3] == [(0, 6), (7, 16), (17, 29)]
    chunks = blocks.greedy_chunks(p, 3, 5).filter("doc_id = 1").orderBy("chunk").collect()
    assert [(r.first_position, r.last_position, r.n_tokens) for r in chunks] == [(0, 1, 5), (2, 2, 3), (3, 4, 4), (5, 6, 3)]
    assert blocks.greedy_groups([1, 9, 400, 500, 10], 400, 800) == [0, 0, 0, 1, 1]


def test_canonical(spark, tmp_path):
    assert canonical.canonical_json({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    assert canonical.framed_hash(["ab", "c"]) != canonical.framed_hash(["a", "bc"])
    h = spark.createDataFrame([(canonical.sha256(str(i)),) for i in range(500)], "h string")
    a, b = (canonical.corpus_fingerprint(x, "h", "1").first()[0] for x in (h.repartition(3), h.orderBy("h")))
    assert a == b != canonical.corpus_fingerprint(h.limit(499), "h", "1").first()[0]
    path = str(tmp_path / "rows")
    canonical.write_jsonl(spark.createDataFrame([(2, None), (1, "x")], "b long, a string"), path)
    schema = T.StructType().add("a", "string").add("b", "long")
    assert {tuple(r) for r in canonical.strict_jsonl(spark, path, schema).collect()} == {(None, 2), ("x", 1)}
    (tmp_path / "q.csv").write_text("q_id,query_en\n1,x\n")
    good = T.StructType().add("q_id", "string").add("query_en", "string")
    assert canonical.strict_csv(spark, str(tmp_path / "q.csv"), good).count() == 1
    with pytest.raises(Exception):
        canonical.strict_csv(spark, str(tmp_path / "q.csv"), T.StructType().add("id", "string").add("query_en", "string")).collect()
    want = spark.createDataFrame([("q.csv", canonical.sha256("q_id,query_en\n1,x\n")), ("gone", "0")], "name string, sha256 string")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "q.csv").write_text("q_id,query_en\n1,x\n")
    assert {r.name: r.status for r in canonical.verified_files(spark, str(tmp_path / "d"), want).collect()} == {"q.csv": "ok", "gone": "missing"}
