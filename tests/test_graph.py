"""Cycles against a plain closure."""

import random
import time

import pytest

from ledgerloom.operators import graph


def plain(edges):
    nodes = {x for e in edges for x in e if None not in e}
    reach = {n: {b for a, b in edges if a == n and b is not None} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    return {(n, min(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes if n in reach[n]}


def check(spark, edges):
    df = spark.createDataFrame(edges, "parent long, child long").repartition(3)
    members = graph.cycles(df)
    got = {tuple(r) for r in members.collect()}
    assert got == plain(edges) and members.count() == len(got)
    ways = {}
    for r in graph.witness(df, members).collect():
        ways.setdefault(r.cycle, {})[r.position] = r.node
    assert set(ways) == {c for _, c in got}
    for c, way in ways.items():
        assert sorted(way) == list(range(len(way))) and len(set(way.values())) == len(way)
        assert all((way[i], way[(i + 1) % len(way)]) in edges and (way[i], c) in got for i in way)


@pytest.mark.parametrize("seed, nodes, n", [(3, 12, 30)])
def test_random_graphs(spark, seed, nodes, n):
    r = random.Random(seed)
    check(spark, [(r.randrange(nodes), r.randrange(nodes)) for _ in range(n)] + [(None, 3), (4, None), (5, 5)])


def test_no_choice_anywhere(spark):
    """Every node has two edges in and out, so only colours find the components."""
    two = [(b + i, b + (i + k) % 5) for b in (0, 10) for i in range(5) for k in (1, 2)]
    check(spark, two + [(0, 11), (1, 13), (20, 0), (20, 1), (21, 20), (22, 20), (21, 22)])


def test_nothing(spark):
    assert graph.cycles(spark.createDataFrame([], "parent long, child long")).collect() == []
    check(spark, [(1, 2), (2, 3), (1, 3)])


def test_long_chain_and_cycle(spark):
    edges = [(i, i + 1) for i in range(1000)] + [(5000 + i, 5000 + (i + 1) % 100) for i in range(100)] + [(1000, 5007)]
    df = spark.createDataFrame(edges, "parent long, child long")
    began = time.time()
    got = {tuple(r) for r in graph.cycles(df).collect()}
    assert got == {(5000 + i, 5000) for i in range(100)}
    print("took", time.time() - began)
    way = {r.position: r.node for r in graph.witness(df, spark.createDataFrame(list(got), "node long, cycle long")).collect()}
    assert way == {i: 5000 + i for i in range(100)}
