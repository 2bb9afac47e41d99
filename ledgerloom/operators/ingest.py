"""Filings from pages to chunks as one plan: each page is parsed once
into typed blocks, cells, contexts, units and facts; sections, chunk records and a summary follow from these."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import token_count
from ..sources import xbrl
from ..sources.html import Element, tree
from ..sources.written import Rounds
from . import blocks, tables

#: Elements that hold others and end a run of text; those that are a block by themselves; those that are left out.
BOXES = {"html", "body", "div", "article", "section", "main", "form", "ul", "ol", "dl", "center", "blockquote", "ix:continuation"}
OWN = blocks.HEADINGS | {"p", "li", "pre", "dt", "dd", "figcaption"}
LEFT_OUT = {"script", "style", "noscript", "template", "head", "ix:header", "ix:hidden", "nav", "footer"}
BLOCK = "position bigint, block_type string, text string, n_cells bigint, n_period_cells bigint, fact_ids array<string>"


def blocks_of(root: Element, cells_of: Callable[[Element], list[dict]] = tables.cells_of) -> list[tuple]:
    """(block_type, text, n_cells, n_period_cells, fact_ids) in document order, without recursion. A table is one block, its text row by row; a heading is a heading
    element, a part, item or note, or a short block in bold type; loose text between blocks is a paragraph."""
    out: list[tuple] = []
    loose: list[Element | str] = []

    def text_block(e: Element, kind: str | None = None) -> None:
        said = e.text(frozenset(LEFT_OUT))
        if said:
            style = " ".join([e.attrs.get("style", ""), *[x.attrs.get("style", "") for x in e.walk() if x.text() == said], *["font-weight:bold" for x in e.all("b", "strong") if x.text() == said]])
            is_heading = kind == "heading" or re.match(blocks.HEADING.replace("^(?i)", ""), said, re.I) and len(said) <= 140 or blocks.bold(style, said)
            out.append(("heading" if is_heading else "paragraph", said, 0, 0, tables.fact_ids(_holder([e]))))

    def flush() -> None:
        if loose:
            text_block(_holder(loose))
            loose.clear()

    stack: list[Element | str] = list(reversed(root.inner))
    while stack:
        e = stack.pop()
        if isinstance(e, str):
            loose.append(e)
        elif e.tag in LEFT_OUT:
            continue
        elif e.tag == "" and e.attrs.get("end"):
            flush()
        elif e.tag == "table":
            flush()
            got = cells_of(e)
            said = tables.serialised(e, got) or e.text()
            if said:
                out.append(("table", said, len(got), sum(c["period_end"] is not None for c in got), tables.fact_ids(_holder([e]))))
        elif e.tag in OWN and not e.all("table", *BOXES):
            flush()
            text_block(e, "heading" if e.tag in blocks.HEADINGS else None)
        elif e.tag in BOXES or e.tag in OWN or e.all("table", "p", "div"):
            flush()
            stack.append(Element("", {"end": "1"}, None))
            stack += reversed(e.inner)
        else:
            loose.append(e)
    flush()
    return out


def _holder(inner: list) -> Element:
    e = Element("", {}, None)
    e.inner = list(inner)
    return e


KINDS = ("block", "cell", "context", "unit", "fact")
FIELDS = dict(zip(KINDS, (BLOCK.replace("position bigint, ", ""), tables.CELL_SCHEMA, xbrl.CONTEXT, xbrl.UNIT, xbrl.FACT)))
NAMES = {k: [x.split()[0] for x in f.split(", ")] for k, f in FIELDS.items()}
ROW = "kind string, position bigint, " + ", ".join(f"{k} struct<{re.sub(r'([a-z_]+) ', r'`\1`:', f)}>" for k, f in FIELDS.items())
#: Characters of pages whose rows are made at once.
CHARS = 1 << 20


def rows_of(page: str | None) -> Iterator[tuple[str, int, dict]]:
    """(kind, position, fields) of all that a page has, from one tree in which each table is read once."""
    root, known = tree(page), {}

    def cells_of(e: Element) -> list[dict]:
        if id(e) not in known:
            known[id(e)] = tables.cells_of(e)
        return known[id(e)]

    for i, b in enumerate(blocks_of(root, cells_of)):
        yield "block", i, dict(zip(NAMES["block"], b))
    cells = [c | {"table_no": t} for t, e in enumerate(root.all("table")) for c in cells_of(e)]
    for kind, rows in (("cell", cells), ("context", xbrl.contexts_of(root)), ("unit", xbrl.units_of(root)), ("fact", xbrl.facts_of(root))):
        for i, r in enumerate(rows):
            yield kind, i, r


def parsed(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, kind, position, block, cell, context, unit, fact): a row for all that a page has, of which the struct of its kind is set. Pages are parsed once, in
    Arrow batches; rows of about a million characters are made at once. Pages without text have no rows."""
    schema = StructType([pages.schema[key], *StructType.fromDDL(ROW).fields])
    arrow = to_arrow_schema(schema)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = [[r[n] for r in rows] for n in range(3)] + [[r[3] if r[1] == k else None for r in rows] for k in KINDS]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for k, page in zip(b.column(0), b.column(1)):
                page, k = page.as_py(), k.as_py()
                rows += [(k, *r) for r in rows_of(page)]
                held += len(page or "")
                if held >= CHARS:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    return pages.select(key, html).mapInArrow(run, schema)


class _Page:
    def eval(self, page: str) -> Iterator[tuple]:
        for kind, i, r in rows_of(page):
            yield kind, i, *[tuple(r[n] for n in NAMES[k]) if k == kind else None for k in KINDS]


#: A table function: page text -> rows of every kind.
parse_page = udtf(_Page, returnType=ROW)


def register(spark: SparkSession) -> None:
    """SQL's LATERAL parse_page(html), with the rows of parsed(). It is called page by page, so parsed() is the faster way."""
    spark.udtf.register("parse_page", parse_page)


def part(rows: DataFrame, kind: str, key: str = "doc_id") -> DataFrame:
    """The rows of parsed() of one kind, with its fields."""
    return rows.filter(F.col("kind") == kind).select(key, "position", f"{kind}.*")


def facts_of(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The facts of parsed() with their contexts and units; the table is read for each of them, so it should be a written one, as in ingest()."""
    return xbrl.resolved(*[part(rows, k, key) for k in ("fact", "context", "unit")], key)


def placed(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks with char_start, char_end and n_tokens: a block's start counts one separator after each block before it."""
    before = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return rows.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text")).withColumn("n_tokens", token_count(F.col("text")))


def filing_blocks(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, position, block_type, text, n_cells, n_period_cells, fact_ids, char_start, char_end, n_tokens)."""
    return placed(part(parsed(pages, key, html), "block", key), key)


#: The headings of which each kind ends a part, item, note or section.
RESETS = {"part": (), "item": ("part",), "section": ("part", "item", "note"), "note": ("part", "item", "section")}


def sectioned(rows: DataFrame, root: Column | None = None, key: str = "doc_id") -> DataFrame:
    """Blocks with section_path and section: part, item, section (the last heading of another kind) and note; a part ends the item, section and note before it, an
    item the section and note, a note the section and a section the note. An exhibit's name comes first (`root`)."""
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    said = F.lower(F.regexp_extract(F.trim("text"), blocks.HEADING, 1))
    kind = F.when(F.col("block_type") == "heading", F.coalesce(*[F.when(said.startswith(k), k) for k in ("part", "item", "note")], F.lit("section")))
    own, path = rows.withColumn("_kind", kind), []
    for name, ends in RESETS.items():
        last = F.last(F.when(F.col("_kind") == name, F.struct(F.col("position").alias("p"), F.col("text").alias("t"))), ignorenulls=True).over(w)
        ended = F.max(F.when(F.col("_kind").isin(*ends), F.col("position"))).over(w) if ends else F.lit(None).cast("long")
        path.append(F.when(ended.isNull() | (last["p"] > ended), last["t"]))
    own = own.withColumn("section_path", blocks.rooted(F.array_distinct(F.array_compact(F.array(*path))), F.lit(None).cast("string") if root is None else root))
    return own.withColumn("section", F.array_join("section_path", " > ")).drop("_kind")


def ingest(pages: DataFrame, key: str = "doc_id", html: str = "html", root: Column | None = None) -> dict[str, DataFrame]:
    """pages (key, html) -> blocks, cells, contexts, chunks, facts and summary (one row: documents, blocks, tables, chunks, facts, cells with a header's period). Pages are
    parsed once: what they have is written to the shared folder and read from there by all of these."""
    own = Rounds(pages.sparkSession, "parsed").put(parsed(pages, key, html))
    rows = sectioned(placed(part(own, "block", key), key), root, key)
    chunks = blocks.chunk_records(rows, key)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    table = F.when(F.col("block.block_type") == "table", 1).otherwise(0)
    counts = own.agg(F.count("block").alias("blocks"), n(table).alias("tables"), n("block.n_period_cells").alias("period_cells"), F.count("fact").alias("facts"))
    summary = counts.crossJoin(pages.agg(F.count("*").alias("documents"))).crossJoin(chunks.agg(F.count("*").alias("chunks")))
    return {"blocks": rows, "cells": part(own, "cell", key), "contexts": part(own, "context", key), "chunks": chunks, "facts": facts_of(own, key), "summary": summary}
