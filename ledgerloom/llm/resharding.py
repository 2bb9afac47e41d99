"""Operator 4: resharding by minimum-cost flow.

Old shard sizes are supplies and new shards' capacities demands; a byte that stays costs nothing, a byte that moves costs `cost`. The flow says how many
bytes go from each old shard to each new one. Documents are the blocks: each old shard lists them largest first, so the part that stays holds the
large ones, and each transfer takes the next run of the list. Documents over 1/64 of a shard ("heavy", at most 64 for each new shard, a bound by
counting) are placed one by one first, outside the flow: at home while it has room, else where most room is.

The flow works on the shard graph alone; documents are numbered by range-dealt running sums over their sizes, so no shard is ever gathered in one task. A plan
is the first document of each run (at most one for each pair of shards) and the heavy ones, so any row finds its new shard by comparing itself with those:
texts don't move for it. rewrite() deals the rows of shards that lose or gain documents once, in the order of their new shard, and writes those shards' files; all
other files stay. Slots come from the written files.

Edge cases: a null text has no bytes; null doc_ids are kept and first in their shard; repeated rows are separate rows, and rows equal in doc_id and text
always go together; equal texts needn't share a shard (no groups are kept together); a very long text is heavy; ties in size go by doc_id and text hash; an
empty table gives no rows; other columns, whatever their names, are ignored by plan() and kept by rewrite().
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, ranged, running_sums, scratch, small_table

HEAVY = 64


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Units from each source to each sink at least total cost; sums of supply and demand are equal. Shortest augmenting paths with potentials."""
    a, b = len(supply), len(demand)
    left, room = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    pot = [0] * (a + b)
    while True:
        dist, back, done = [float("inf")] * (a + b), [-1] * (a + b), [False] * (a + b)
        heap = []
        for i in range(a):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        if not heap:
            return {k: v for k, v in flow.items() if v}
        heapq.heapify(heap)
        end = -1
        while heap:
            d, x = heapq.heappop(heap)
            if done[x]:
                continue
            done[x] = True
            if x >= a and room[x - a]:
                end = x
                break
            near = ((a + j, cost(x, j)) for j in range(b)) if x < a else ((i, -cost(i, x - a)) for i in range(a) if flow.get((i, x - a)))
            for y, c in near:
                nd = d + c + pot[x] - pot[y]
                if not done[y] and nd < dist[y]:
                    dist[y], back[y] = nd, x
                    heapq.heappush(heap, (nd, y))
        for x in range(a + b):
            pot[x] += min(dist[x], dist[end])
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        push = min([left[path[0]], room[end - a], *(flow[(y, x - a)] for x, y in zip(path, path[1:]) if x >= a)])
        for x, y in zip(path, path[1:]):
            if x < a:
                flow[(x, y - a)] = flow.get((x, y - a), 0) + push
            else:
                flow[(y, x - a)] -= push
        left[path[0]] -= push
        room[end - a] -= push


def level(loads: list[int], total: int) -> list[int]:
    """Whole units, total in all, that bring the loads as near to one level as they can."""
    order = sorted(range(len(loads)), key=lambda j: (loads[j], j))
    out, n, top = [0] * len(loads), len(loads), 0
    while n and (top := (sum(loads[j] for j in order[:n]) + total) // n) < loads[order[n - 1]]:
        n -= 1
    for j in order[:n]:
        out[j] = top - loads[j]
    for j in order[: total - sum(out)]:
        out[j] += 1
    return out


def place_heavy(heavy: list[tuple[int, int, int]], shards: int, total: int) -> tuple[dict[int, int], list[int]]:
    """heavy: (rank, old shard, size), largest first -> {rank: shard}, loads."""
    loads, out, room = [0] * shards, {}, -(-total // shards)
    for rank, old, size in heavy:
        j = old if 0 <= old < shards and loads[old] + size <= room else min(range(shards), key=lambda k: (loads[k], k))
        out[rank] = j
        loads[j] += size
    return out, loads


def _assign(batches: Iterator[pa.RecordBatch], cuts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Light rows (n, d, h, old, start) by where they start in their old shard's list: cuts[old] = (ends of the transfers, new shards)."""
    for b in batches:
        old, at = b.column(3).to_numpy(), b.column(4).to_numpy()
        new = np.zeros(len(old), np.int32)
        for s in np.unique(old):
            ends, to = cuts[int(s)]
            m = old == s
            new[m] = to[np.minimum(np.searchsorted(ends, at[m], side="right"), len(to) - 1)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new)], names=["n", "d", "h", "old", "start", "new"])


def _size(text: str = "text") -> Column:
    return (F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + 1).cast("long")


def _place() -> list[Column]:
    """What orders an old shard's list: size downwards, doc_id, hash of the text."""
    return [(-_size()).alias("n"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h")]


@dataclass
class Plan:
    """runs: (old shard, (n, d, h) of its first document, new shard), in the order of the lists; heavy: (old shard, (n, d, h), new shard); transfers:
    {(old, new): bytes} of the flow over light documents."""

    shards: int
    limit: int
    runs: list
    heavy: list
    transfers: dict

    def affected(self) -> list[int]:
        """Shards that lose or gain documents."""
        pairs = {(o, j) for o, _, j in self.runs} | {(o, j) for o, _, j in self.heavy}
        return sorted({x for p in pairs if p[0] != p[1] for x in p if 0 <= x < self.shards})

    def emptied(self) -> list[int]:
        """Old shards beyond the new ones: all their documents go, so their files can be dropped once the others are written."""
        return sorted({o for o, _, _ in [*self.runs, *self.heavy] if not 0 <= o < self.shards})

    def shard_of(self, docs: DataFrame, old: str, shard: str) -> DataFrame:
        """docs, where column `old` holds old shards, with new ones in column `shard`. A map over rows."""
        spark, (o, keys, to, me, lead) = docs.sparkSession, free(docs, "_old", "_keys", "_to", "_me", "_lead")
        kind = "struct<n:bigint,d:bigint,h:bigint>"
        lists: dict[int, list] = {}
        for x, first, j in self.runs:
            lists.setdefault(x, []).append((first, j))
        table = small_table(spark, [(x, [f for f, _ in r], [j for _, j in r]) for x, r in lists.items()], f"{o} int, {keys} array<{kind}>, {to} array<int>")
        out = docs.withColumn(me, F.struct(*_place())).join(F.broadcast(table), F.col(old) == F.col(o), "left").drop(o)
        run = F.size(F.filter(keys, lambda k: k <= F.col(me)))
        out = out.withColumn(shard, F.when(-F.col(me)["n"] <= self.limit, F.try_element_at(F.col(to), F.greatest(run, F.lit(1)))))
        if self.heavy:
            table = small_table(spark, [(x, f, j) for x, f, j in self.heavy], f"{o} int, {keys} {kind}, {lead} int")
            out = out.drop(keys).join(F.broadcast(table), (F.col(old) == F.col(o)) & F.col(me).eqNullSafe(F.col(keys)), "left").withColumn(shard, F.coalesce(lead, shard))
        return out.select(*[F.col(f"`{c}`") for c in docs.columns], shard)


def plan(docs: DataFrame, old: str, shards: int = 16, cost=lambda i, j: int(i != j)) -> Plan:
    """docs: doc_id, text and a column `old` (int, not null) of old shards."""
    spark = docs.sparkSession
    rows = docs.select(*_place(), F.col(old).alias("old"), _size().alias("size"))
    listed, sums = running_sums(ranged(rows, F.asc("old"), F.asc("n"), F.asc_nulls_first("d"), F.asc("h")), "size", "old", "reshard")
    total = sum(x for x, _ in sums.values())
    limit = max(1, total // (shards * HEAVY))
    base, at = [], {}
    for (part, o), (size, _) in sorted(sums.items()):
        base.append((part, o, at.get(o, 0)))
        at[o] = at.get(o, 0) + size
    listed = listed.join(F.broadcast(small_table(spark, base, "_p int, _o int, _base bigint")), (F.col("_part") == F.col("_p")) & (F.col("old") == F.col("_o")))
    listed = listed.select("n", "d", "h", "old", (F.col("_base") + F.col("_before")).alias("start"))
    # Heavy documents lead their old shard's list.
    heavy = sorted((-r.n, r.old, r.start, r.d, r.h) for r in listed.filter(F.col("n") < -limit).collect())
    heavy = sorted(heavy, key=lambda x: (-x[0], x[1], x[2]))
    placed, loads = place_heavy([(k, x[1], x[0]) for k, x in enumerate(heavy)], shards, total)
    lead: dict[tuple, int] = {}
    for k, (size, o, _, d, h) in enumerate(heavy):
        lead.setdefault((o, (-size, d, h)), placed[k])
    skip: dict[int, int] = {}
    for size, o, *_ in heavy:
        skip[o] = skip.get(o, 0) + size
    olds = sorted(at)
    light = [at[o] - skip.get(o, 0) for o in olds]
    flow = min_cost_flow(light, level(loads, sum(light)), lambda i, j: cost(olds[i], j))
    cuts = {}
    for i, o in enumerate(olds):
        to = sorted((j for (x, j) in flow if x == i), key=lambda j: (cost(o, j), j))
        ends = skip.get(o, 0) + np.cumsum([flow[(i, j)] for j in to], dtype=np.int64)
        cuts[o] = (ends, np.array(to or [0], np.int32))
    runs = listed.filter(F.col("n") >= -limit).mapInArrow(lambda it: _assign(it, cuts), "n bigint, d bigint, h bigint, old int, start bigint, new int")
    runs = runs.groupBy("old", "new").agg(F.min(F.struct("start", "n", "d", "h")).alias("first")).collect()
    runs = sorted(((r.old, r["first"].start, (r["first"].n, r["first"].d, r["first"].h), r.new) for r in runs), key=lambda x: x[:2])
    return Plan(shards, limit, [(o, f, j) for o, _, f, j in runs], [(o, f, j) for (o, f), j in lead.items()], {(olds[i], j): n for (i, j), n in flow.items()})


def _by_shard(shard: str) -> list[Column]:
    return [F.asc(shard), F.asc_nulls_first("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))]


def rewrite(docs: DataFrame, old: str, plan: Plan, path: str) -> list[int]:
    """docs: the rows as they are stored, `old` their old shards. Writes <path>/shard=N of every shard that loses or gains documents, with every column of its
    rows but `old`, and `place`, which orders a shard's rows; folders of other shards stay as they are, also under a path that docs is read from. Returns the
    shards written. Columns of docs named shard or place stay; the written ones then have more underscores."""
    affected = plan.affected()
    shard, place = free(docs, "shard", "place")
    rows = plan.shard_of(docs, old, shard).filter(F.col(shard).isin(affected)).drop(old)
    rows = ranged(rows, *_by_shard(shard)).withColumn(place, F.monotonically_increasing_id())
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)
    return affected


def with_slots(files: DataFrame, shard: str = "shard", place: str = "place") -> DataFrame:
    """Rows of rewritten shards with slot, gapless from 0 in each shard, instead of place. The driver gets a row for each shard and task that wrote it."""
    part = F.shiftright(place, 33)
    sums = files.groupBy(shard, part.alias("part")).agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()
    base, at = [], {}
    for r in sorted(sums, key=lambda r: (r[shard], r.part)):
        base.append((r[shard], r.part, at.get(r[shard], 0) - r["first"]))
        at[r[shard]] = at.get(r[shard], 0) + r.n
    s, p, b = free(files, "_s", "_p", "_b")
    base = small_table(files.sparkSession, base, f"{s} int, {p} bigint, {b} bigint")
    out = files.join(F.broadcast(base), (F.col(shard) == F.col(s)) & (part == F.col(p))).withColumn("slot", F.col(b) + F.col(place))
    return out.drop(s, p, b, place)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (shard, doc_id, text_crc32 and others) with slot, gapless from 0 in each shard, by doc_id."""
    order = [F.asc("shard"), F.asc_nulls_first("doc_id"), F.asc("text_crc32")]
    table, sums = running_sums(ranged(rows.withColumn("_one", F.lit(1).cast("long")), *order), "_one", "shard", "slots")
    base, at = [], {}
    for (part, shard), (n, _) in sorted(sums.items()):
        base.append((part, shard, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + n
    base = small_table(rows.sparkSession, base, "_p int, _s int, _base bigint")
    out = table.join(F.broadcast(base), (F.col("_part") == F.col("_p")) & (F.col("shard") == F.col("_s")))
    return out.withColumn("slot", F.col("_base") + F.col("_before")).select(*rows.columns, "slot")


def op4(spark: SparkSession, docs: DataFrame, old_shards: int = 12, shards: int = 16) -> DataFrame:
    """From 12 shards by a hash of doc_id to 16 of near equal bytes: plans, writes the affected shards' files and reads slots and digests back from them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(old_shards)).cast("int").alias("old"))
    rows = rows.withColumn("old_shard", F.col("old"))
    how, path = plan(rows, "old", shards), scratch(spark, "shards")
    affected = rewrite(rows, "old", how, path)
    text = F.coalesce("text", F.lit(""))
    columns = ["doc_id", _size().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "old_shard"]
    same = numbered(how.shard_of(rows, "old", "shard").filter(~F.col("shard").isin(affected)).select(*columns))
    if affected:
        files = spark.read.schema("doc_id bigint, text string, old_shard int, place bigint, shard int").parquet(path)
        same = with_slots(files).select(*columns, "slot").unionByName(same)
    return same.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
