"""Stores, bundles, citations and table surroundings on small hand-made cases."""

from datetime import date

import pytest

from ledgerloom.operators import citations
from ledgerloom.sources import canonical, store


def test_raw_store(tmp_path):
    s = store.RawStore.load(str(tmp_path))
    assert s.ensure("d1", lambda: b"one") == b"one" and s.ensure("d1", lambda: b"two") == b"one"
    again = store.RawStore.load(str(tmp_path))
    assert again.verified("d1") == b"one"
    (tmp_path / "d1.htm").write_bytes(b"changed")
    for bad in (lambda: again.verified("d1"), lambda: again.verified("d2"), lambda: again.ensure("../x", lambda: b""), lambda: (tmp_path / "d1.htm").unlink() or again.verified("d1")):
        with pytest.raises(store.StoreError):
            bad()
    text = (tmp_path / "manifest.json").read_text()
    (tmp_path / "manifest.json").write_text(text.replace('"sha256":"', '"sha256":"0'))
    with pytest.raises(store.StoreError):
        store.RawStore.load(str(tmp_path))


def test_bundles():
    files = {"b/x": b"1", "a": b"2"}
    data = store.bundle(files)
    want = {k: store.sha256(v) for k, v in files.items()}
    assert data == store.bundle(dict(reversed(files.items()))) and store.unbundled(data, want) == files
    for expected, blob in (({"a": want["a"]}, data), (want | {"c": "0"}, data), (want | {"a": "0"}, data), (want, store.bundle({"../a": b""}))):
        with pytest.raises(store.StoreError):
            store.unbundled(blob, expected)


def test_vectors_are_cached_by_identity(spark, tmp_path):
    calls = []

    def compute(n):
        calls.append(n)
        return spark.createDataFrame([(1, [0.5] * n)], "key long, embedding array<float>")

    me = {"model": "m", "dimension": 2, "texts": "f"}
    for _ in range(2):
        assert store.cached_vectors(spark, str(tmp_path / "v"), me, lambda: compute(2)).first().embedding == [0.5, 0.5]
    store.cached_vectors(spark, str(tmp_path / "v"), me | {"texts": "g"}, lambda: compute(2))
    assert calls == [2, 2]
    with pytest.raises(store.StoreError):
        store.cached_vectors(spark, str(tmp_path / "v"), me | {"texts": "h"}, lambda: compute(3))


def test_index_pages():
    page = "<table class='tableFile'><tr><th>a</th></tr><tr><td>1</td><td>Ex</td><td><a href='/e.htm'>e</a></td><td>EX-99.1</td></tr><tr><td>2</td><td>x</td><td><a href='/ix?doc=/a/b.htm'>b</a></td><td>10-K</td></tr></table>"
    assert store.filing_document(page, "10-k") == "/a/b.htm" and store.filing_document(page, "EX-99") == "/e.htm" and store.filing_document(page, "8-K") is None


def test_locators(spark):
    rows = [("L", ["A"], "d", 1, 2), ("", ["A", "B"], "d", 1, 2), (None, [], "d", 1, 2), (None, [], "d", None, 2)]
    df = spark.createDataFrame(rows, "locator string, section_path array<string>, doc_id string, char_start long, char_end long")
    assert [r.x for r in df.select(citations.locator().alias("x")).collect()] == ["L", "A > B", "d chars 1-2", None]


def test_what_surrounds_a_table(spark):
    rows = [("d", "s", 0, "heading", "SALES BY REGION", None, None, None), ("d", "s", 1, "paragraph", "(in millions)", None, None, None), ("d", "s", 2, "table", "t", None, "", ["1", "a"]), ("d", "s", 3, "paragraph", "---", None, None, None),
            ("d", "s", 4, "paragraph", "(1) Note one", None, None, None), ("d", "s", 5, "paragraph", "Other text", None, None, None), ("d", "s", 6, "paragraph", "(a) late", None, None, None), ("d", "u", 7, "table", "t2", 3, "own", [])]
    df = spark.createDataFrame(rows, "doc_id string, section string, position long, block_type string, text string, scale int, caption string, refs array<string>")
    got = {r.position: (r.scale, r.caption) for r in citations.inherit_table_metadata(df).filter("block_type = 'table'").collect()}
    assert got == {2: (6, "SALES BY REGION"), 7: (3, "own")}
    assert {r.position: r.table_position for r in citations.attach_footnotes(df).filter("block_type = 'footnote'").collect()} == {4: 2}


def test_periods_of_cells(spark):
    d = date
    ctx = spark.createDataFrame([("d", "c2", d(2024, 1, 1), d(2024, 3, 31), 0), ("d", "c1", d(2024, 1, 2), d(2024, 3, 31), 1), ("d", "c3", None, d(2024, 3, 31), 0)], "doc_id string, context_id string, period_start date, period_end date, n_dimensions int")
    cells = spark.createDataFrame([("d", 1, None, d(2024, 3, 31), 3), ("d", 2, None, d(2024, 3, 31), 12)], "doc_id string, cell_id long, period_start date, period_end date, months int")
    got = {r.cell_id: (r.period_start, r.period_source) for r in citations.start_from_contexts(cells, ctx).collect()}
    assert got == {1: (d(2024, 1, 1), "c2"), 2: (None, None)}
    head = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p"), (4, None)], "cell_id long, period string")
    links = spark.createDataFrame([(1, "p"), (2, "q"), (2, "q"), (3, "q"), (3, "r"), (4, None)], "cell_id long, period string")
    assert {r.cell_id: (r.period, r.reconciliation) for r in citations.reconcile_periods(head, links).collect()} == {1: ("p", "agrees"), 2: ("q", "direct_fact"), 3: ("p", "direct_ambiguous"), 4: (None, "header")}
    facts = spark.createDataFrame([("d", -5.0, "c1", "e1"), ("d", 5.0, "c2", "e2"), ("d", 7.0, "c3", "e1")], "doc_id string, scaled double, context_id string, period_end string")
    asked = spark.createDataFrame([(1, "d", 5.0, "e1"), (2, "d", 5.0, None), (3, "d", 7.0, "e9"), (4, "d", 9.0, None)], "cell_id long, doc_id string, magnitude double, period_end string")
    assert {r.cell_id: (r.context_id, r.status) for r in citations.match_by_value(asked, facts).collect()} == {1: ("c1", "assigned_unique"), 2: (None, "rejected_ambiguous"), 3: (None, "no_compatible_fact"), 4: (None, "no_compatible_fact")}


def test_fingerprint_counts_rows_without_a_hash(spark):
    one = lambda *h: canonical.corpus_fingerprint(spark.createDataFrame([(x,) for x in h], "h string"), "h", "1").first().fingerprint
    assert len({one("ab1"), one("ab1", None), one("ab1", None, None), one("ab1", "ab1")}) == 4 and one("ab1", None, "cd2") == one(None, "cd2", "ab1")
