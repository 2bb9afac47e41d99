"""Interval joins beside all pairs."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import intervals


@pytest.mark.parametrize("salt", [1, 3])
def test_within_equals_all_pairs(spark, salt):
    r = random.Random(5)
    some = lambda: r.choice([0.0, -0.0, 1.0, 5e-324, 1e300, -1e300, r.uniform(-1, 1), r.uniform(-1e6, 1e6), 2.0 ** r.randint(-60, 60), float(r.randint(-9, 9))])
    left = [(i, r.choice("ab"), x, x + abs(r.choice([0.0, 1e-9, 1.0, some()]))) for i in range(300) for x in [some()]]
    left += [(300, "a", None, 1.0), (301, "a", 2.0, 1.0), (302, "a", -math.inf, math.inf), (303, "b", 0.0, math.inf), (304, "a", math.nan, 1.0), (305, "a", 0.0, math.nan)]
    right = [(i, r.choice("ab"), x) for i, x in enumerate([r.choice(left[:300])[2 + i % 2] if i % 3 else some() for i in range(300)])] + [(300, "a", None), (301, "b", math.inf), (302, "a", math.nan), (303, None, 1.0)]
    want = sorted((i, j) for i, k, lo, hi in left for j, m, v in right if k == m and None not in (lo, hi, v) and not math.isnan(lo + hi if abs(lo) + abs(hi) < math.inf else 0) and lo == lo and hi == hi and lo <= v <= hi)
    a, b = spark.createDataFrame(left, "i int, k string, lo double, hi double"), spark.createDataFrame(right, "j int, k string, v double")
    got = intervals.within(a, b, "lo", "hi", "v", ("k",), salt)
    assert sorted(tuple(x) for x in got.select("i", "j").collect()) == want and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert intervals.within(a.limit(0), b, "lo", "hi", "v").count() == 0 == intervals.within(a.drop("k"), b.limit(0), "lo", "hi", "v").count()


def test_one_hot_value(spark):
    a = spark.range(50).select(F.col("id").alias("i"), F.lit(0.5).alias("lo"), F.lit(1.5).alias("hi"))
    b = spark.range(3000).select(F.col("id").alias("j"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") + 2.0).alias("v"))
    assert intervals.within(a, b, "lo", "hi", "v", salt=4).count() == 50 * 1000


def test_cells_of_a_precision(spark):
    d = spark.createDataFrame([(Decimal(x),) for x in ("2.5", "3.5", "3.2", "-2.5")], "x decimal(10,2)").select(intervals.cell(F.col("x"), F.lit(1).cast("decimal(4,0)")).alias("c"))
    assert [(float(r.c.low), float(r.c.high), r.c.closed) for r in d.collect()] == [(1.5, 2.5, True), (3.5, 4.5, True), (2.5, 3.5, False), (-2.5, -1.5, True)]


def test_numeric_matches(spark):
    t = spark.createDataFrame([(1, "USD_thousand", "gaap", "2024", 5.0), (2, "USD", None, None, -7.0), (3, "boxes", "gaap", "2024", 5.0)], "target_id int, unit string, basis string, period string, stated double")
    f = spark.createDataFrame([
        (1, "USD", "gaap", "2024", 5000.4), (2, "USD", "gaap", "2023", 5000.0), (3, "USD", None, "2024", 5000.0), (4, "USD", None, None, 7.0), (5, "USD", None, None, -7.2), (6, "boxes", "gaap", "2024", 5.0), (7, "crates", "gaap", "2024", 5.0), (8, "USD", "", "", 7.0),
    ], "found_id int, unit string, basis string, period string, value double")
    got = lambda **k: sorted(tuple(r) for r in intervals.numeric_matches(t, f, F.lit(0.5), **k).collect())
    assert got() == [(1, 1, True), (2, 5, True), (3, 6, True)] and got(signed=False) == [(1, 1, True), (2, 4, False), (2, 5, True), (3, 6, True)]
