"""Loads that check what they read: sources, corpora of chunks, queries, fact indexes, gold bundles, files of pinned hash."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import constraints
from ..operators.metrics import WEIGHTS
from .canonical import canonical_json, sha256, strict_csv


def lookup(sources: DataFrame, key: str, value) -> dict:
    """The one row of a source relation; none, or several, is an error."""
    rows = sources.filter(F.col(key) == F.lit(value)).limit(2).collect()
    if len(rows) != 1:
        raise KeyError(f"{'no' if not rows else 'more than one'} row with {key} = {value!r}")
    return rows[0].asDict(recursive=True)


#: Seconds between requests, tries after the first, seconds to wait a try, and answers that are worth another try.
PAUSE, RETRIES, BACK_OFF, AGAIN = 0.25, 4, 1.5, {403, 429, *range(500, 600)}


class Fetcher:
    """Throttled requests with retries on the driver; `opened` and `sleep` can be replaced."""

    def __init__(self, agent: str, opened: Callable = urllib.request.urlopen, sleep: Callable = time.sleep, clock: Callable = time.monotonic):
        self.agent, self.opened, self.sleep, self.clock, self.last = agent, opened, sleep, clock, None

    def get(self, url: str) -> tuple[bytes, str]:
        """(body, content type). Refused and failing answers are tried again, later each time; any other error answer is raised at once."""
        for n in range(RETRIES + 1):
            if self.last is not None and (wait := self.last + PAUSE - self.clock()) > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                with self.opened(urllib.request.Request(url, headers={"User-Agent": self.agent})) as r:
                    return r.read(), r.headers.get("Content-Type", "")
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or n == RETRIES:
                    raise
            except urllib.error.URLError:
                if n == RETRIES:
                    raise
            self.sleep(BACK_OFF * (n + 1))
        raise AssertionError("unreachable")


def pinned(spark: SparkSession, path: str, expected: dict[str, tuple[int, str]]) -> None:
    """Files under path must be exactly those of expected: name -> (bytes, sha256)."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256")).collect()
    got = {r.name: (r.length, r.sha256) for r in found}
    if got != expected:
        names = sorted(k for k in {*got, *expected} if got.get(k) != expected.get(k))
        raise constraints.Broken(f"missing, unexpected or changed: {names}")


def corpus(chunks: DataFrame, manifest: DataFrame, fingerprint: str | None = None, fields: tuple = ("company", "form", "filing_date", "period_of_report")) -> DataFrame:
    """Chunks with their filing's fields (the manifest's win), checked: chunk ids are there and unique, documents are in the manifest, and the corpus is the expected one
    (corpus_fingerprint over the manifest's chunk hashes)."""
    constraints.require(constraints.together(
        constraints.holds(chunks, ["doc_id"], F.col("chunk_id").isNotNull() & (F.col("chunk_id") != ""), "a chunk has an id"), constraints.unique(chunks, ["chunk_id"], "a chunk id occurs once"),
        constraints.refers(chunks, "doc_id", manifest, "doc_id", "a chunk's document is in the manifest"), constraints.unique(manifest, ["doc_id"], "a document occurs once"),
    ))
    if fingerprint is not None and (found := corpus_identity(manifest)) != fingerprint:
        raise constraints.Broken(f"another corpus: {found}")
    own = [c for c in fields if c in manifest.columns]
    return chunks.drop(*[c for c in own if c in chunks.columns]).join(manifest.select("doc_id", *own), "doc_id")


def corpus_identity(manifest: DataFrame) -> str:
    from .canonical import corpus_fingerprint

    return corpus_fingerprint(manifest.select("chunk_sha256"), "chunk_sha256", "1").first().fingerprint or sha256("")


def corpus_maps(chunks: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keyed form for provenance: chunks by chunk_id, entries by doc_id, each key once."""
    constraints.require(constraints.together(constraints.unique(chunks, ["chunk_id"], "a chunk id occurs once"), constraints.unique(manifest, ["doc_id"], "a document occurs once")))
    return chunks, manifest


def write_artifacts(rows: DataFrame, path: str, key: str = "doc_id", expected: DataFrame | None = None) -> DataFrame:
    """Writes rows as JSON lines by key and returns (key, sha256) of each key's rows in canonical order; with `expected` (key, sha256) any drift is an error and
    nothing is written."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    hashes = rows.select(key, F.sha2(line.cast("binary"), 256).alias("h")).groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ",").cast("binary"), 256).alias("sha256"))
    if expected is not None:
        j = hashes.join(expected.select(key, F.col("sha256").alias("_e")), key, "full_outer")
        constraints.require(constraints.holds(j, [key], F.col("sha256") == F.col("_e"), "an artifact is the expected one"))
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return hashes


def queries(spark: SparkSession, path: str, count: int | None = None, pinned_sha256: str | None = None) -> DataFrame:
    """A file of exactly q_id,query_en: both filled, ids unique, as many as expected, of the expected hash."""
    schema = T.StructType([T.StructField("q_id", T.StringType()), T.StructField("query_en", T.StringType())])
    df = strict_csv(spark, path, schema)
    constraints.require(constraints.together(constraints.unique(df, ["q_id"], "a query id occurs once"), constraints.holds(df, ["q_id"], (F.trim("q_id") != "") & (F.trim("query_en") != ""), "a query has an id and a text")))
    n = df.count()
    if not n or count is not None and n != count:
        raise constraints.Broken(f"{n} queries")
    if pinned_sha256 is not None and [r.s for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("s")).collect()] != [pinned_sha256]:
        raise constraints.Broken("another file of queries")
    return df


def fact_index(facts: DataFrame) -> DataFrame:
    """Facts by what identifies them: an empty unit is none, the time is one struct with its kind, the value a decimal or null."""
    kind = F.when(F.col("instant").isNotNull(), "instant").otherwise("duration")
    return facts.select(
        F.concat_ws("#", "accession", "fact_id").alias("fact_locator"), "accession", "concept", F.col("context_id").alias("context_ref"), F.nullif("unit", F.lit("")).alias("unit"), "chunk_id",
        F.struct(kind.alias("kind"), "instant", "period_start", "period_end").alias("temporal"), F.col("value").cast("decimal(38,10)").alias("value"),
    )


def gold_bundle(questions: DataFrame, answers: DataFrame, checklist: DataFrame, manifest: DataFrame) -> DataFrame:
    """questions (q_id, question, allowed_accessions), answers (q_id, fact_id, value, unit, input_fact_ids), checklist (q_id, item_id, importance, chunk_ids), manifest
    (accession): one row a question with its nested answers and evidence. Lists are separated by `;`, without empty or repeated members; every reference exists;
    importance has its weight."""
    items = lambda c: F.split(F.col(c), ";")
    whole = lambda c: F.col(c).isNotNull() & (F.size(F.array_distinct(F.transform(items(c), lambda x: F.trim(x)))) == F.size(items(c))) & F.forall(items(c), lambda x: F.trim(x) != "")
    named = questions.select("q_id", F.explode(items("allowed_accessions")).alias("accession"))
    inputs = answers.filter("input_fact_ids <> ''").select("q_id", F.explode(items("input_fact_ids")).alias("input"))
    constraints.require(constraints.together(
        constraints.unique(questions, ["q_id"], "a question occurs once"), constraints.unique(answers, ["fact_id"], "an answer's fact occurs once"), constraints.unique(checklist, ["q_id", "item_id"], "an item occurs once"),
        constraints.refers(answers, "q_id", questions, "q_id", "an answer's question exists"), constraints.refers(checklist, "q_id", questions, "q_id", "an item's question exists"),
        constraints.refers(named, "accession", manifest, "accession", "an accession exists"), constraints.refers(inputs, "input", answers, "fact_id", "an input exists"),
        constraints.holds(questions, ["q_id"], whole("allowed_accessions"), "a list is whole"), constraints.holds(checklist, ["q_id", "item_id"], whole("chunk_ids"), "a list is whole"),
        constraints.holds(checklist, ["q_id", "item_id"], F.col("importance").isin(list(WEIGHTS)), "importance is known"),
    ))
    weight = F.element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("importance"))
    a = answers.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "value", "unit", F.when(F.col("input_fact_ids") != "", items("input_fact_ids")).alias("inputs")))).alias("answers"))
    e = checklist.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "importance", weight.alias("weight"), items("chunk_ids").alias("chunk_ids")))).alias("evidence"))
    return questions.withColumn("allowed_accessions", items("allowed_accessions")).join(a, "q_id", "left").join(e, "q_id", "left")


def bundle_hash(bundle: dict) -> str:
    return sha256(canonical_json(bundle))
