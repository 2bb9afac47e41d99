"""Requirement graphs (parent, child): closure and levels by recursive plans, cycles as strongly connected components by rounds over written tables.

Components come from four steps, repeated on the edges that are left. All are joins and partial sums; only row counts reach the driver.

1. Ways without a choice. A node with one edge in has one predecessor, so predecessors make a forest whose trees hang on nodes with no edge in, or several, and on cycles. Pointer
   doubling follows all ways at once in as many rounds as their length has binary digits. What hangs on a node with no edge in is on no cycle; a way that never ends is on a cycle or behind
   one, and what 2^k steps back lead to are the cycles themselves.
2. The same along edges out.
3. When neither finds anything, nodes with one edge in and one out are drawn together into edges, by doubling too, and the smaller graph is solved in the same way; they
   are on a cycle if the ends of their edge are on one cycle.
4. Colours, when no such node is left: the greatest node that reaches a node is its colour. Within a colour, what reaches the node it is named after is one component.

A chain of n edges takes log n rounds, in and between cores alike; only cores in which every node has several edges in and out need as many rounds as their colours take to spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import Rounds


def leaves(edges: DataFrame) -> DataFrame:
    """(root, leaf): the distinct nodes without children that each parent reaches. The graph must have no cycle (see cycles())."""
    return edges.sparkSession.sql(
        """WITH RECURSIVE reach AS (SELECT DISTINCT parent AS root, child FROM {edges} UNION ALL SELECT r.root, e.child FROM reach r JOIN {edges} e ON e.parent = r.child)
        SELECT DISTINCT root, child AS leaf FROM reach r WHERE NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.parent = r.child)""",
        edges=edges,
    )


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest way down from a node without parents; inputs come after what needs them."""
    return edges.sparkSession.sql(
        """WITH RECURSIVE walk AS (SELECT DISTINCT parent AS node, 0 AS level FROM {edges} e WHERE NOT EXISTS (SELECT 1 FROM {edges} x WHERE x.child = e.parent)
          UNION ALL SELECT e.child, w.level + 1 FROM walk w JOIN {edges} e ON e.parent = w.node)
        SELECT node, max(level) AS level FROM walk GROUP BY node""",
        edges=edges,
    )


def followed(pointers: DataFrame, rounds: Rounds) -> DataFrame:
    """pointers (node, to, dead): one row a node; `to` is null at an end, which may be a dead one. -> (node, to, least, steps, ended, dead): where the way from node ends, the least
    node on it, its length and what its end is; if it never ends, a node of the cycle that it runs into, `least` being that cycle's least node if node is on it."""
    to = F.coalesce("to", "node")
    cur = pointers.select("node", to.alias("to"), F.least("node", to).alias("least"), F.col("to").isNotNull().cast("long").alias("steps"), F.col("to").isNull().alias("ended"), "dead", F.lit(True).alias("lower"))
    some = lambda c: F.count(F.when(c, 1))
    sums = {"left": some(~F.col("ended")), "lower": some(F.col("lower"))}
    (cur, now), before = rounds.counted(cur, **sums), None
    while now["left"]:
        on = cur.select(F.col("node").alias("to"), *[F.col(c).alias(f"_{c}") for c in ("to", "least", "steps", "ended", "dead")])
        # A turn that ends no way leaves only those that never end: the node one step beyond the span would have ended. A turn that finds no lesser node has gone all round every
        # cycle; all have reached theirs when one more turn would lead to as many nodes.
        if now["left"] == before and not now["lower"]:
            j = cur.filter("NOT ended").join(on, "to").agg(F.count_distinct("to").alias("a"), F.count_distinct("_to").alias("b")).first()
            if j.a == j.b:
                break
        before = now["left"]
        moved = cur.filter("NOT ended").join(on, "to").select("node", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_ended").alias("ended"), F.col("_dead").alias("dead"), (F.col("_least") < F.col("least")).alias("lower"))
        new, now = rounds.counted(cur.filter("ended").withColumn("lower", F.lit(False)).unionByName(moved), **sums)
        rounds.drop(cur)
        cur = new
    return cur.drop("lower")


def _ways(edges: DataFrame, rounds: Rounds, a: str, b: str) -> DataFrame:
    """Follows the edges from b to a while a node has one: (node, cycle) of the nodes that this settles, cycle being null for those on none."""
    one = edges.groupBy(F.col(b).alias("node")).agg(F.count("*").alias("n"), F.min(a).alias("to"))
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).distinct().join(one, "node", "left")
    at = followed(nodes.select("node", F.when(F.col("n") == 1, F.col("to")).alias("to"), F.col("n").isNull().alias("dead")), rounds)
    on = at.filter("NOT ended").join(at.filter("NOT ended").select(F.col("to").alias("node")).distinct(), "node", "left_semi")
    free = at.filter("ended AND dead").select("node", F.lit(None).cast(at.schema["node"].dataType).alias("cycle"))
    return rounds.put(free.unionByName(on.select("node", F.col("least").alias("cycle"))))


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    for side in ("parent", "child"):
        edges = edges.join(nodes.select(F.col("node").alias(side)), side, "left_anti")
    return edges.select("parent", "child")


def _coloured(edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """(nodes settled, (node, cycle) of components found): those of the nodes that colours are named after."""
    cur = rounds.put(edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct().select("node", F.col("node").alias("colour")))
    changed = True
    while changed:
        sent = edges.join(cur.select(F.col("node").alias("parent"), "colour"), "parent").groupBy(F.col("child").alias("node")).agg(F.max("colour").alias("_c"))
        new, now = rounds.counted(cur.join(sent, "node", "left").select("node", F.greatest("colour", "_c").alias("colour"), (F.col("_c") > F.col("colour")).alias("more")), changed=F.count(F.when(F.col("more"), 1)))
        rounds.drop(cur)
        cur, changed = new.drop("more"), now["changed"]
    c = cur
    inner = edges.join(c.toDF("parent", "colour"), "parent").join(c.toDF("child", "_c"), "child").filter("colour = _c").select("parent", "child", "colour")
    inner = rounds.put(inner)
    front = reached = rounds.put(c.filter("node = colour"))
    n = 1
    while n:
        step = inner.join(front.select(F.col("node").alias("child")), "child", "left_semi").select(F.col("parent").alias("node"), "colour").distinct().join(reached.select("node"), "node", "left_anti")
        front, now = rounds.counted(step, n=F.count("*"))
        n, reached = now["n"], reached.unionByName(front)
    size = reached.groupBy("colour").agg(F.min("node").alias("cycle"), F.count("*").alias("n")).filter("n > 1")
    return reached.select("node"), rounds.put(reached.join(size, "colour").select("node", "cycle"))


def _drawn_together(edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame, int]:
    """(edges between the nodes that stay, (node, first, last) of those that don't: the ends of the edge that they are part of, number of these)."""
    side = lambda here, there: edges.groupBy(F.col(here).alias("node")).agg(F.count("*").alias(f"n_{there}"), F.min(there).alias(there))
    both = rounds.put(side("child", "parent").join(side("parent", "child"), "node").withColumn("thin", (F.col("n_parent") == 1) & (F.col("n_child") == 1)))
    first, last = (followed(both.select("node", F.when(F.col("thin"), F.col(c)).alias("to"), F.lit(False).alias("dead")), rounds).select("node", F.col("to").alias(n)) for c, n in (("parent", "first"), ("child", "last")))
    ends, now = rounds.counted(both.select("node", "thin").join(first, "node").join(last, "node"), n=F.count(F.when(F.col("thin"), 1)))
    kept = edges.join(ends.filter("NOT thin").select(F.col("node").alias("child")), "child", "left_semi").join(ends.select(F.col("node").alias("parent"), "first"), "parent")
    return kept.select(F.col("first").alias("parent"), "child").distinct(), ends.filter("thin").select("node", "first", "last"), now["n"]


def _redrawn(inner: DataFrame, thin: DataFrame, rounds: Rounds) -> DataFrame:
    """inner: cycles() of the smaller graph. The same with the nodes drawn together, named anew by their least nodes."""
    at = lambda end: inner.select(F.col("node").alias(end), F.col("cycle").alias(f"{end}_cycle"))
    on = thin.join(at("first"), "first").join(at("last"), "last").filter("first_cycle = last_cycle").select("node", F.col("first_cycle").alias("cycle"))
    every = rounds.put(inner.unionByName(on))
    return every.join(every.groupBy("cycle").agg(F.min("node").alias("least")), "cycle").select("node", F.col("least").alias("cycle"))


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): every node on a cycle with the least node of its strongly connected component. An edge from a node to itself is a cycle; null ends make no edge."""
    rounds = Rounds(edges.sparkSession, "cycles")
    whole = rounds.put(edges.select("parent", "child").dropna().distinct())
    loops = whole.filter("parent = child").select(F.col("parent").alias("node"), F.col("parent").alias("cycle"))
    live, now = rounds.counted(whole.filter("parent <> child"), n=F.count("*"))
    out, n = None, now["n"]
    while n:
        before = n
        for a, b in (("parent", "child"), ("child", "parent")):
            if n:
                settled = _ways(live, rounds, a, b)
                found = settled.filter("cycle IS NOT NULL")
                out = found if out is None else out.unionByName(found)
                live, now = rounds.counted(_without(live, settled), n=F.count("*"))
                n = now["n"]
        if n == before:
            smaller, thin, drawn = _drawn_together(live, rounds)
            if drawn:
                out = out.unionByName(_redrawn(cycles(smaller), thin, rounds))
                break
            settled, found = _coloured(live, rounds)
            out = out.unionByName(found)
            live, now = rounds.counted(_without(live, settled), n=F.count("*"))
            n = now["n"]
    return loops if out is None else out.unionByName(loops.join(out.select("node"), "node", "left_anti"))


def witness(edges: DataFrame, members: DataFrame) -> DataFrame:
    """members: cycles(edges). (cycle, position, node): one closed way for each component, from its least node on: every node goes on to its least successor within the component, and of the
    cycles that this makes the one with the least node is taken."""
    rounds = Rounds(edges.sparkSession, "witness")
    m = rounds.put(members)
    inside = edges.select("parent", "child").dropna().join(m.toDF("parent", "cycle"), "parent").join(m.toDF("child", "_c"), "child").filter("cycle = _c")
    on = rounds.put(inside.groupBy(F.col("parent").alias("node"), "cycle").agg(F.min("child").alias("to")))
    at = followed(on.select("node", "to", F.lit(False).alias("dead")), rounds)
    ring = at.join(at.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", "least").join(on, "node")
    best = ring.groupBy("cycle").agg(F.min("least").alias("least"))
    ring = rounds.put(ring.join(best, ["cycle", "least"]).select("node", "cycle", "least", "to"))
    steps = followed(ring.select("node", F.when(F.col("node") != F.col("least"), F.col("to")).alias("to"), F.lit(False).alias("dead")), rounds).select("node", "steps")
    n = ring.groupBy("cycle").agg(F.count("*").alias("n"))
    return ring.join(steps, "node").join(n, "cycle").select("cycle", F.pmod(F.col("n") - F.col("steps"), F.col("n")).alias("position"), "node")


def cyclic(edges: DataFrame) -> DataFrame:
    """(parent, child) of the edges on cycles or leading to one, found back from the cycles' nodes; as many rounds as the longest way to a cycle."""
    rounds = Rounds(edges.sparkSession, "cyclic")
    whole = rounds.put(edges.select("parent", "child").distinct())
    reached = rounds.put(cycles(whole).select("node"))
    front = reached
    while front.limit(1).count():
        front = rounds.put(whole.join(front.select(F.col("node").alias("child")), "child", "left_semi").select(F.col("parent").alias("node")).distinct().join(reached, "node", "left_anti"))
        reached = reached.unionByName(front)
    return whole.join(reached.select(F.col("node").alias("child")), "child", "left_semi").select("parent", "child")
