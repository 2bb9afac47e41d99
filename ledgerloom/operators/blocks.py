"""Blocks of documents: paragraphs with offsets, sections, chunks and row groups; HTML pages as blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import squeeze, token_count

MIN_TOKENS, MAX_TOKENS, ROWS_A_CHUNK = 400, 800, 40
#: Headings by their beginnings.
HEADING = r"^(?i)(part\s+[ivx]+|item\s+\d+[a-z]?\.?|note\s+\d+)\b"
#: Weights of type that count as bold.
BOLD = {"700", "800", "bold"}
SKIP = {"script", "style", "head", "noscript", "template", "nav", "footer"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEAVES = HEADINGS | {"p", "li", "td", "th", "blockquote", "pre", "figcaption", "dt", "dd"}


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position, text, char_start, char_end, n_tokens): lines of a text in order; a line's start counts one separator after each line before it."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("position", "text"))
    before = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    rows = rows.withColumn("char_start", start)
    return rows.select(key, F.col("position").cast("long").alias("position"), "text", "char_start", (F.col("char_start") + F.length("text")).cast("long").alias("char_end"), token_count(F.col("text")).alias("n_tokens"))


def section_paths(blocks: DataFrame, heading: Column, key: str = "doc_id", position: str = "position", text: str = "text") -> DataFrame:
    """Adds is_heading and section: the text of the last heading at or before a block."""
    w = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("is_heading", heading).withColumn("section", F.last(F.when(heading, F.col(text)), ignorenulls=True).over(w))


def outline(blocks: DataFrame, key: str = "doc_id", position: str = "position", text: str = "text") -> DataFrame:
    """Adds part, item, note and path by the state machine of headings: a part resets item and note, an item resets the note."""
    w = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    kind = F.lower(F.regexp_extract(F.trim(F.col(text)), HEADING, 1))
    level = F.when(kind.startswith("part"), 1).when(kind.startswith("item"), 2).when(kind.startswith("note"), 3)
    out = blocks.withColumn("_level", level)
    marks = {1: "part", 2: "item", 3: "note"}
    for n, name in marks.items():
        own = F.when(F.col("_level") == n, F.struct(F.col(position).alias("p"), F.col(text).alias("t")))
        reset = F.max(F.when(F.col("_level") < n, F.col(position))).over(w)
        last = F.last(own, ignorenulls=True).over(w)
        out = out.withColumn(name, F.when(reset.isNull() | (last["p"] > reset), last["t"]))
    return out.withColumn("path", F.array_join(F.array_compact(F.array("part", "item", "note")), " > ")).drop("_level")


def suppress_running_headers(blocks: DataFrame, key: str = "doc_id", position: str = "position", text: str = "text", ahead: int = 3) -> DataFrame:
    """Adds is_heading: a bare "PART I" or "ITEM 2." is a running header, and no heading, if of the next three blocks the first that isn't bare is ordinary
    text rather than a heading with words of its own."""
    s = F.trim(F.col(text))
    bare = F.regexp_like(s, F.lit(r"^(?i)(part\s+[ivx]+|item\s+\d+[a-z]?)\.?$"))
    kind = F.when(bare, "bare").when(heading(F.col(text)), "heading").otherwise("text")
    w = Window.partitionBy(key).orderBy(position)
    out = blocks.withColumn("_kind", kind)
    coming = F.array_compact(F.array(*[F.nullif(F.lead("_kind", n).over(w), F.lit("bare")) for n in range(1, ahead + 1)]))
    out = out.withColumn("_next", F.try_element_at(coming, F.lit(1)))
    running = (F.col("_kind") == "bare") & (F.col("_next") == "text")
    return out.withColumn("is_heading", (F.col("_kind") != "text") & ~F.coalesce(running, F.lit(False))).drop("_kind", "_next")


def linked(chunks: DataFrame, key: str = "doc_id", position: str = "position", chunk: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(position)
    return chunks.withColumn("prev_chunk_id", F.lag(chunk).over(w)).withColumn("next_chunk_id", F.lead(chunk).over(w))


def chunk_id(doc: Column, position: Column, start: Column, end: Column, suffix: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of doc:position:start:end:suffix."""
    return F.substring(F.sha2(F.concat_ws(":", doc.cast("string"), position.cast("string"), start.cast("string"), end.cast("string"), suffix).cast("binary"), 256), 1, 16)


def greedy_groups(sizes: list[int], least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> list[int]:
    """Number of the chunk of each block: a chunk ends where the next block would take it over `most` and it has `least` already."""
    out, n, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i and held + size > most and held >= least:
            n, held = n + 1, 0
        out.append(n)
        held += size
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _greedy(sizes: pd.Series, least: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([greedy_groups(list(x), a, b) for x, a, b in zip(sizes, least, most)])


def greedy_chunks(blocks: DataFrame, least: int = MIN_TOKENS, most: int = MAX_TOKENS, key: str = "doc_id") -> DataFrame:
    """(key, chunk, first_position, last_position, n_blocks, n_tokens): blocks packed in order. Only the sizes of a document's blocks are gathered, as
    one array; text never moves."""
    sizes = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "n_tokens"))).alias("b"))
    rows = sizes.select(key, F.explode(F.arrays_zip(F.col("b.position").alias("p"), F.col("b.n_tokens").alias("n"), _greedy("b.n_tokens", F.lit(least), F.lit(most)).alias("c"))).alias("x"))
    return rows.groupBy(key, F.col("x.c").alias("chunk")).agg(F.min("x.p").alias("first_position"), F.max("x.p").alias("last_position"), F.count("*").alias("n_blocks"), F.sum("x.n").alias("n_tokens"))


def row_groups(rows: DataFrame, key: str, order: list[str], size: int = ROWS_A_CHUNK) -> DataFrame:
    """Adds row_idx and the group's start row as suffix."""
    out = rows.withColumn("row_idx", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    return out.withColumn("suffix", (F.floor(F.col("row_idx") / size) * size).cast("int"))


def chunk_groups(sizes: list[int], kinds: list[str], sections: list[str | None], least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> list[int]:
    """Number of the chunk of each block: a table stands alone; a heading or another section begins a chunk; else text is packed as in greedy_groups()."""
    out, n, held, last = [], -1, 0, None
    for size, kind, section in zip(sizes, kinds, sections):
        fresh = last is None or kind in ("table", "heading") or last[0] == "table" or section != last[1]
        if fresh or held + size > most and held >= least:
            n, held = n + 1, 0
        out.append(n)
        held, last = held + size, (kind, section)
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _chunked(sizes: pd.Series, kinds: pd.Series, sections: pd.Series, least: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([chunk_groups(list(x), list(k), list(s), a, b) for x, k, s, a, b in zip(sizes, kinds, sections, least, most)])


def chunk_numbers(blocks: DataFrame, key: str = "doc_id", section: str = "section", least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """(key, position, chunk) of blocks (key, position, n_tokens, block_type, section). Sizes, kinds and hashes of sections of a document are gathered; texts
    aren't."""
    own = F.struct("position", "n_tokens", "block_type", F.sha1(F.col(section).cast("string").cast("binary")).alias("s"))
    rows = blocks.groupBy(key).agg(F.array_sort(F.collect_list(own)).alias("b"))
    n = _chunked("b.n_tokens", "b.block_type", "b.s", F.lit(least), F.lit(most))
    return rows.select(key, F.explode(F.arrays_zip(F.col("b.position").alias("position"), n.alias("chunk"))).alias("x")).select(key, "x.position", "x.chunk")


def chunk_records(blocks: DataFrame, key: str = "doc_id", least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """Chunks of blocks (key, position, text, char_start, char_end, n_tokens, block_type, section, fact_ids): key, chunk_no, chunk_id, block_type, section, text
    (joined by blank lines), n_tokens, char_start, char_end, first_position, last_position, fact_ids (distinct, in order), retrieval_text (the section before the
    text), prev_chunk_id, next_chunk_id."""
    numbers = chunk_numbers(blocks, key, "section", least, most).hint("merge")  # a row for each block, which Spark's estimate of arrays makes too small and would broadcast
    rows = blocks.join(numbers, [key, "position"])
    one = rows.groupBy(key, F.col("chunk").alias("chunk_no")).agg(
        F.array_sort(F.collect_list(F.struct("position", "text", "block_type", "section", "fact_ids"))).alias("b"), F.sum("n_tokens").alias("n_tokens"),
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min("position").alias("first_position"), F.max("position").alias("last_position"),
    )
    kind = F.when(F.exists("b", lambda x: x["block_type"] == "table"), "table").when(F.forall("b", lambda x: x["block_type"] == "heading"), "heading").otherwise("text")
    text = F.array_join(F.col("b.text"), "\n\n")
    out = one.select(
        key, "chunk_no", chunk_id(F.col(key), F.col("first_position"), F.col("char_start"), F.col("char_end"), F.lit("")).alias("chunk_id"), kind.alias("block_type"),
        F.col("b")[0]["section"].alias("section"), text.alias("text"), "n_tokens", "char_start", "char_end", "first_position", "last_position",
        F.array_distinct(F.flatten(F.filter(F.col("b.fact_ids"), lambda x: x.isNotNull()))).alias("fact_ids"),
    )
    out = out.withColumn("retrieval_text", F.concat_ws("\n", F.nullif("section", F.lit("")), "text"))
    return linked(out, key, "chunk_no")


def period_columns(cells: DataFrame, by: list[str]) -> DataFrame:
    """The distinct (period_start, period_end, header) of a table's columns, in the order in which they first appear."""
    seen = cells.filter("period_end IS NOT NULL").groupBy(*by, "period_start", "period_end", "header").agg(F.min("col").alias("col"))
    return seen.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("col", "period_start", "header")) - 1)


def rooted(path: Column, root: Column) -> Column:
    """A section path that begins with its root (an exhibit's name); null roots change nothing."""
    path = F.coalesce(path, F.array().cast("array<string>"))
    return F.when(root.isNull() | (F.coalesce(F.try_element_at(path, F.lit(1)), F.lit("")) == root), path).otherwise(F.concat(F.array(root), path))


def bold(style: str, text: str) -> bool:
    """A short block in bold type stands as a heading."""
    m = re.search(r"font-weight\s*:\s*(\w+)", style or "", re.I)
    return bool(m) and m[1].lower() in BOLD and 0 < len(text) <= 140


class PageBlocks(HTMLParser):
    """Ordered leaf blocks (type, text) of a page; unclosed elements end where the next block begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.kind, self.buffer, self.skip, self.title, self.links = "paragraph", [], [], "", 0
        self.in_title = False

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.out.append((self.kind, text))
        self.buffer, self.kind = [], "paragraph"

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in SKIP:
            self._flush()
            self.skip.append(tag)
        elif not self.skip:
            self.links += tag == "a" and any(k == "href" and v for k, v in attrs)
            if tag in LEAVES or tag in ("div", "article", "section", "table", "tr", "ul", "ol", "br"):
                self._flush()
                self.kind = "heading" if tag in HEADINGS else "cell" if tag in ("td", "th") else "paragraph"
        if tag == "body":
            self.skip = []

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.skip:
            del self.skip[self.skip.index(tag) :]
        elif not self.skip and (tag in LEAVES or tag in ("div", "article", "section", "table", "tr", "ul", "ol", "body", "html")):
            self._flush()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.skip:
            self.buffer.append(data)

    def close(self):
        super().close()
        self._flush()


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, title, position, block_type, text, char_start, char_end)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, html in zip(pdf.page_id, pdf.html):
                p, at = PageBlocks(), 0
                p.feed(html or "")
                p.close()
                for i, (kind, text) in enumerate(p.out):
                    rows.append((page, " ".join(p.title.split()), i, kind, text, at, at + len(text)))
                    at += len(text) + 1
            yield pd.DataFrame(rows, columns=["page_id", "title", "position", "block_type", "text", "char_start", "char_end"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, title string, position bigint, block_type string, text string, char_start bigint, char_end bigint")


def heading(text: Column) -> Column:
    """A prefix of a part, item or note, or a short line in capitals without a full stop."""
    s = squeeze(text)
    short = (F.length(s) <= 140) & ~s.endswith(".") & (F.length(s) > 0)
    return F.regexp_like(s, F.lit(HEADING)) | (short & F.regexp_like(s, F.lit(r"^\p{Lu}[^\p{Ll}]*$")))
