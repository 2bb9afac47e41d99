"""Connected components: links are joined into stars inside each task, then nodes take their least neighbour until all links are stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, written

#: Links that a task joins at once (some 100 bytes each while it does).
AT_ONCE = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least node, node) of every other node of each component of the links (u, v)."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        m = x != y
        a, b = a[m], b[m]
        np.minimum.at(label, np.maximum(x, y)[m], np.minimum(x, y)[m])
        while not np.array_equal(label, up := label[label]):
            label = up
    m = label != np.arange(len(nodes))
    return nodes[label[m]], nodes[m]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(t.column(0).to_numpy(), t.column(1).to_numpy())], names=["a", "b"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= AT_ONCE:
            held = [joined()]
            if held[0].num_rows >= AT_ONCE // 2:
                yield held.pop()
    if held:
        yield joined()


def contracted(links: DataFrame) -> DataFrame:
    """Two columns of links -> (a, b): the same components by stars, each task's links joined where they lie."""
    return links.mapInArrow(_contracted, "a bigint, b bigint")


def connected(links: DataFrame, max_rounds: int = 60, settle: bool = True) -> DataFrame:
    """(u, v) -> (node, label), a row for each node with a lesser one: its least reachable node.

    Links are stars once no node has a lesser neighbour and another one as well. Until then every node tells its neighbours the least of them, and that one
    of all others (hash-to-min), about log(nodes) rounds, fewer as tasks join their links. The least neighbour is found with partial sums, so a centre of
    many links costs no task more than others; what it tells comes from a join of two plain exchanges, which adaptive execution splits when skewed. Nothing
    but the answer whether a round was the last reaches the driver. settle=False takes what the first look gives: labels are reachable, not yet least."""
    edges = contracted(links)
    for _ in range(max_rounds):
        edges = written(edges, "cc")
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = written(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), "cc-least")
        if not settle or not near.filter("m < u AND m <> most").head(1):
            return near.filter("m < u").select(F.col("u").alias("node"), F.col("m").alias("label"))
        told = both.join(dealt(near.select("u", F.least("m", "u").alias("m"))), "u").filter("v <> m").select("m", "v")
        own = near.filter("m < u").select("m", F.col("u").alias("v"))
        edges = contracted(told.unionByName(own))
    raise RuntimeError("links did not settle")
