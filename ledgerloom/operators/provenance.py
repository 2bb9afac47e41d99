"""Passages found in their sources, and smallest sets of chunks that serve all parts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze


def fingerprint(text: Column) -> Column:
    """SHA-256 of a source's text in lower case with white space collapsed."""
    return F.sha2(squeeze(F.lower(text)).cast("binary"), 256)


#: Characters of passages searched for in one pass over the texts; a task's automaton takes some fifty bytes for each.
PASSAGE_CHARS = 4_000_000


def _located(batches: Iterator[pa.RecordBatch], handle) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to (key, passage, char_start): the first place of each passage in each text."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for passage, h in zip(handle.value.column(1).to_pylist(), handle.value.column(0).to_pylist()):
        automaton.add_word(passage, (h, len(passage)))
    automaton.make_automaton()
    for b in batches:
        row, found, start = [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            first: dict[int, int] = {}
            for end, (h, n) in automaton.iter(text or ""):
                first.setdefault(h, end - n + 1)
            row += [i] * len(first)
            found += first.keys()
            start += first.values()
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(found, pa.int64()), pa.array(start, pa.int64())], names=["key", "passage", "char_start"])


def passages_in(docs: DataFrame, passages: DataFrame, key: str = "doc_id", pkey: str = "item_id", text: str = "text", most: int = PASSAGE_CHARS) -> DataFrame:
    """(pkey, key, char_start) of documents that hold a passage as written, and where it first starts, in characters. Different passages become one automaton (Aho and Corasick) that
    finds all of them, of whatever length, in one run through a text; more than `most` characters of them are searched in several passes, each with its share by hash. Passages meet their
    ids again by a join on the passages' hashes. A null or empty passage is nowhere."""
    spark = docs.sparkSession
    asked = passages.filter(F.length(text) > 0).select(F.xxhash64(text).alias("passage"), F.col(text).alias("_p"), pkey)
    different = asked.groupBy("passage").agg(F.min("_p").alias("_p"))
    total = different.agg(F.coalesce(F.sum(F.length("_p")), F.lit(0))).first()[0]
    groups, out = max(1, -(-total // most)), None
    schema = f"key {docs.schema[key].dataType.simpleString()}, passage bigint, char_start bigint"
    for g in range(groups):
        handle = spark.sparkContext.broadcast(different.filter(F.pmod(F.xxhash64("passage"), F.lit(groups)) == g).toArrow())
        found = docs.select(F.col(key).alias("key"), text).mapInArrow(lambda it, handle=handle: _located(it, handle), schema)
        out = found if out is None else out.unionByName(found)
    return out.join(asked, "passage").select(pkey, F.col("key").alias(key), "char_start").distinct()


def smallest_hitting_set(parts: list[set]) -> list | None:
    """The smallest set that meets every part, first in order among equals; null if a part is empty."""
    if not all(parts):
        return None
    rest = sorted(set().union(*parts))
    need = [p for p in parts if not any(q < p for q in parts)]
    for n in range(len(need) + 1):
        pool = [x for x in rest if any(x in p for p in need)]
        for c in combinations(pool, n):
            s = set(c)
            if all(s & p for p in need):
                return list(c)
    return None


def hitting_sets(gold: DataFrame, by: str, part: str, key: str) -> DataFrame:
    """(by, n_parts, chosen): for each group of parts with their alternatives. Parts and alternatives of a group are few; the search is exponential in them."""
    kind = gold.schema[key].dataType.simpleString()
    group = gold.groupBy(by, part).agg(F.collect_set(key).alias("alternatives")).groupBy(by).agg(F.collect_list("alternatives").alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chosen = [smallest_hitting_set([set(p) for p in parts]) for parts in pdf.parts]
            yield pd.DataFrame({by: pdf[by], "n_parts": [len(p) for p in pdf.parts], "chosen": chosen})

    return group.mapInPandas(run, f"{by} {gold.schema[by].dataType.simpleString()}, n_parts bigint, chosen array<{kind}>")


#: Characters of a source shown around what was found.
EXCERPT = 900


def anchors(found: DataFrame, chunks: DataFrame, manifest: DataFrame, needle: str = "needle") -> DataFrame:
    """found (chunk_id, label, needle): one anchor for each chunk, with its filing, distinct labels in order, and the text around the first needle that it holds.
    anchor_id depends on document and chunk alone."""
    j = found.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id").join(manifest, "doc_id")
    at = F.locate(needle, "text") if isinstance(needle, str) and needle not in found.columns else F.expr(f"locate({needle}, text)")
    start = F.greatest(F.lit(1), at - F.lit(EXCERPT // 2))
    j = j.withColumn("_at", F.when(at > 0, at)).withColumn("_x", F.when(at > 0, F.substring("text", start, F.lit(EXCERPT))).otherwise(F.substring("text", 1, EXCERPT)))
    keep = [c for c in manifest.columns if c != "doc_id"]
    out = j.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.min_by("_x", F.struct(F.col("_at").isNull(), "_at")).alias("excerpt"), *[F.first(c).alias(c) for c in keep])
    h = F.sha2(F.concat_ws(":", "doc_id", "chunk_id").cast("binary"), 256)
    return out.withColumn("anchor_id", F.concat(F.lit("src_"), F.substring(h, 1, 24)))


def match_xbrl(values: DataFrame, facts: DataFrame) -> DataFrame:
    """values (value_id, doc_id, value, exponent, tag): facts of the document with the same magnitude at the stated power of ten whose concept contains the tag, in any
    case; no tag asks for none. An equi-join on document and magnitude, in decimals."""
    size = lambda c: F.abs(c).cast("decimal(38,10)")
    v = values.withColumn("_m", size(F.col("value") * F.pow(F.lit(10.0), F.coalesce("exponent", F.lit(0)))))
    j = v.join(facts.select("doc_id", "fact_id", "concept", size(F.col("scaled")).alias("_m")), ["doc_id", "_m"]).drop("_m")
    return j.filter(F.col("tag").isNull() | F.contains(F.lower("concept"), F.lower("tag")))


def numeric_provenance(wanted: DataFrame, by_fact: DataFrame, by_cell: DataFrame, by_text: DataFrame, inputs: DataFrame) -> DataFrame:
    """wanted (q_id, fact_id, derived); by_* (fact_id, chunk_id); inputs (fact_id, input_id). A direct value has the chunks of the strongest way that found it: facts,
    else cells, else text; a derived one has its inputs' chunks, each once, in the order of inputs and chunks. (q_id, fact_id, status, chunk_ids)."""
    ways = [d.select("fact_id", "chunk_id", F.lit(n).alias("way")) for n, d in enumerate((by_fact, by_cell, by_text))]
    found = ways[0].unionByName(ways[1]).unionByName(ways[2]).distinct()
    best = found.groupBy("fact_id").agg(F.min("way").alias("way"))
    direct = found.join(best, ["fact_id", "way"])
    chunks = direct.groupBy("fact_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    first = inputs.join(direct.select(F.col("fact_id").alias("input_id"), "chunk_id"), "input_id").groupBy("fact_id", "chunk_id").agg(F.min("input_id").alias("_i"))
    union = first.groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "chunk_id"))), lambda x: x["chunk_id"]).alias("derived_ids"))
    lost = inputs.join(direct.select(F.col("fact_id").alias("input_id")).distinct(), "input_id", "left_anti").select("fact_id").distinct().withColumn("_lost", F.lit(True))
    out = wanted.join(chunks, "fact_id", "left").join(union, "fact_id", "left").join(lost, "fact_id", "left")
    ids = F.coalesce(F.when(F.col("derived"), F.col("derived_ids")).otherwise(F.col("chunk_ids")), F.array().cast(chunks.schema["chunk_ids"].dataType))
    status = F.when(F.size("ids") == 0, "missing").when(F.col("derived") & F.col("_lost"), "inputs_missing").when(F.col("derived"), "derived").when(F.size("ids") == 1, "direct_unique").otherwise("direct_or")
    return out.withColumn("ids", ids).select("q_id", "fact_id", status.alias("status"), F.col("ids").alias("chunk_ids"))


def part_groups(atoms: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """atoms (item_id, atom_id, chunk_id), groups (item_id, atom_id, part_id): atoms of one part must have the same alternatives; an atom that no group lists is a part
    of its own. (parts (item_id, part_id, chunk_ids), report of parts whose atoms differ)."""
    own = atoms.groupBy("item_id", "atom_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    named = own.join(groups, ["item_id", "atom_id"], "left").withColumn("part_id", F.coalesce("part_id", F.col("atom_id")))
    g = named.groupBy("item_id", "part_id").agg(F.count_distinct("chunk_ids").alias("n"), F.first("chunk_ids").alias("chunk_ids"))
    return g.filter("n = 1").select("item_id", "part_id", "chunk_ids"), g.filter("n > 1").select(F.lit("one set of alternatives").alias("rule"), F.concat_ws("-", "item_id", "part_id").alias("key"), "n")


def evidence(parts: DataFrame, items: DataFrame, sources: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parts (item_id, part_id, chunk_ids), items (q_id, item_id, importance), sources (chunk_id, accession), allowed (q_id, accession): (items with their parts, all of
    which are needed, each with its alternatives; report of alternatives outside the question's accessions)."""
    each = parts.join(items, "item_id").select("q_id", "item_id", "importance", "part_id", F.explode("chunk_ids").alias("chunk_id")).join(sources, "chunk_id", "left")
    bad = each.join(allowed, ["q_id", "accession"], "left_anti").groupBy("q_id", "chunk_id").agg(F.count("*").alias("n"))
    ok = each.join(allowed.select("q_id", "accession").distinct(), ["q_id", "accession"], "left_semi")
    one = ok.groupBy("q_id", "item_id", "importance", "part_id").agg(F.array_sort(F.collect_set(F.struct("chunk_id", "accession"))).alias("candidate_sources"))
    out = one.groupBy("q_id", "item_id", "importance").agg(F.array_sort(F.collect_list(F.struct("part_id", "candidate_sources"))).alias("parts"))
    return out, bad.select(F.lit("sources are allowed").alias("rule"), F.concat_ws("-", "q_id", "chunk_id").alias("key"), "n")


def finalised(mappings: DataFrame, decisions: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each mapping must meet exactly one approval of its own content (`content_hash`). (approved mappings with decision and reviewer, report of the others)."""
    n = decisions.groupBy(*key).agg(F.count("*").alias("n"), F.first("decision").alias("decision"), F.first("content_hash").alias("_h"))
    j = mappings.join(n, key, "left")
    fault = F.when(F.col("n").isNull(), "no decision").when(F.col("n") > 1, "several decisions").when(F.col("decision") != "approved", "not approved").when(~F.col("_h").eqNullSafe(F.col("content_hash")), "decided on other content")
    bad = j.withColumn("rule", fault).filter("rule IS NOT NULL").select("rule", F.concat_ws("-", *key).alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    return j.filter(fault.isNull()).drop("n", "_h"), bad


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """How often each value, or combination, occurs, and its place by frequency."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))))
