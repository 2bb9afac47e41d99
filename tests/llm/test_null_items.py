"""Benchmark rows without an id are searched as well."""

import pytest

from ledgerloom.llm import wu_manber

LEAK = "one two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize("most", [1, 500_000])
def test_items_without_id_hit(spark, most):
    docs = spark.createDataFrame([(1, f"start {LEAK} end"), (2, f"other words and alpha beta {LEAK}"), (3, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, LEAK), (None, "not in any text"), (7, "alpha beta")], "item_id long, text string")
    found = {r.doc_id: (sum(s.end - s.start for s in r.spans), r["items"]) for r in wu_manber.find(docs, bench, max_patterns=most).collect()}
    assert found == {1: (11, []), 2: (13, [7]), 3: (0, [])}
    assert [r.doc_id for r in wu_manber.clean(docs, bench, max_patterns=most).collect()] == [3]
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in wu_manber.op9(spark, docs, bench).collect()}
    assert got == {1: (11, 0, True), 2: (13, 1, True), 3: (0, 0, False)}
