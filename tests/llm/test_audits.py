"""Operators 12 and 13 against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import filter_audit, importance
from tests.conftest import SF_TINY, tables
from tests.llm.conftest import SCHEMA
from tests.test_queries import plain

# --- 12


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_resample(docs, target, n=1, buckets=10_000, least=20, percent=10, seed=2024):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in texts for b in features(x)) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        f = features(text)
        weight = sum(gain[b] for b in f)
        rows.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    most = percent * len(order) // 100
    return Counter((*r[:4], i + 1 if i < most else None) for i, r in enumerate(order)) + Counter((*r[:4], None) for r in rows if not r[4])


@pytest.mark.parametrize("options", [{}, {"n": 3, "buckets": 50, "least": 5, "percent": 60, "seed": 1}])
def test_resampling_of_odd_rows(spark, odd, options):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(1, "the idiot of été"), (2, None), (3, ""), (3, "Alpha beta; GAMMA_delta x1"), (None, "ünder")]
    got = importance.resample(odd, spark.createDataFrame(items, "item_id long, text string"), **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and [t for _, t in got.dtypes] == ["bigint"] * 5
    assert Counter(tuple(r) for r in got.collect()) == plain_resample(docs, [t for _, t in items], **options)


def test_resampling_of_nothing(spark, odd, none):
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance.op12(spark, none, target).collect() == []
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in importance.op12(spark, odd, target).collect()) == plain_resample(docs, [])


def test_all_scores_equal(spark):
    """Ranks stay gapless where one score holds all rows, over several ranges."""
    docs = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same words " * 15).alias("text"))
    got = importance.resample(docs, docs.limit(1), percent=50)
    assert sorted(r.rank for r in got.filter("rank IS NOT NULL").collect()) == list(range(1, 201))


def test_resampling_stays_in_the_engine(spark, tiny):
    for df in (importance.resample(tiny, tiny.limit(3)), filter_audit.op13(spark, tiny, spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", df._jdf.queryExecution().executedPlan().toString())


# --- 13


def plain_masks(docs):
    first = {}
    for doc, _, text in docs:
        if doc is not None and doc < first.get(text or "", math.inf):
            first[text or ""] = doc
    out = []
    for doc, part, text in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), doc is not None and doc > first[text]]
        out.append((doc, part or "", {c for c, f in zip("ABCDE", fails) if f}))
    return out


def plain_audit(docs, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    rows, shares = [], Counter()
    masks = plain_masks(docs)
    for part in {p for _, p, _ in masks}:
        of = [(d, f) for d, p, f in masks if p == part]
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                gone = [x for x in of if x[1] & set(order[:k])]
                removed = [x for x in of if not x[1] & set(order[:k]) and c in x[1]]
                shares[part, c] += len(removed)
                rows.append((part, order, k + 1, len(of) - len(gone) - len(removed), len(removed), sum(c in f for _, f in gone), sum(f == {c} for _, f in of), sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)))
    return Counter((*r, shares[r[0], r[1][r[2] - 1]]) for r in rows)


COLS13 = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_rows(spark, odd, none):
    many = " ".join(f"w{i}" for i in range(250))
    more = [(200 + i, t, "en", s, 1, *[None] * 20) for i, (t, s) in enumerate([(many, "s1"), (many, None), (many, ""), (many + " #", "s2"), (many.upper(), "s2"), ("a b " * 150, "s1"), ("A" * 2 + "é" * 97 + " x", "s3"), (many + "\x0b\x0c\r" + many, "s4")])]
    docs = odd.unionByName(spark.createDataFrame(more + [(None, many, "en", "s1", 1, *[None] * 20)], SCHEMA))
    labels = [(200, 1, 0), (200, 0, 1), (201, 1, 1), (202, None, 1), (None, 1, 1), (3, 1, None), (5, 2, 1), (9999, 1, 1)]
    got = filter_audit.op13(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(got.columns) == sorted(COLS13) and dict(got.dtypes)["step"] == "int"
    rows = [(r.doc_id, r.source, r.text) for r in docs.select("doc_id", "source", "text").collect()]
    assert Counter(tuple(r) for r in got.select(*COLS13).collect()) == plain_audit(rows, labels)
    assert filter_audit.op13(spark, none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


@pytest.mark.parametrize("of", [(importance, "op12", "benchmark"), (filter_audit, "op13", "labels")])
def test_sql(spark, of):
    module, name, other = of
    got = getattr(module, name)(spark, spark.read.parquet(f"{SF_TINY}/documents.parquet"), spark.read.parquet(f"{SF_TINY}/{other}.parquet"))
    want = tables(SF_TINY).sql(module.ORACLE)
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())
