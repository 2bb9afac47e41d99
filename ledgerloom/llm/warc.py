"""Operator 1: WARC derivative builder.

Each response becomes two linked records: `metadata` (application/warc-fields: title, language, outgoing links, the source's status and headers) and
`conversion` (text/plain). Both keep the response's identifier in WARC-Refers-To with its target URI and date, name each other, and carry SHA-1 digests
of their own blocks beside the response's. Identifiers are name-based, so reruns agree. Everything is a map over responses; nothing is shuffled.

write() emits WARC/1.1 files through Spark's own text writer (records end in CRLF CRLF), so any path Spark can write will do; read() parses them.

Edge cases: a null page_id or URL is kept (null, or an empty header); null HTML is an empty payload; repeated pages give equal records; unclosed tags,
comments and scripts end with the text; a head without its end ends with the first element that can't stand in it; pages of any length are read whole; an
empty table gives no rows; other columns, whatever their names, are ignored. Records that are cut off or lack a length are read as far as they go, and marked.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches

CRLF = b"\r\n"
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"'<]|"[^"<]*+"|'[^'<]*+')*+)>|<[a-z/!?][^>]*+(?:>|\Z)""",
    re.S | re.I,
)
ATTR = re.compile(r"""(?<![a-z-])([a-z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements that end a line.
BLOCK = set("address article aside blockquote br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that can stand in a head; any other one ends it.
HEAD = {"head", "title", "meta", "link", "base", "html"}
#: Elements with links, and the attribute that has them.
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "iframe": "src", "source": "src", "form": "action"}


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def name(*parts: str) -> str:
    """A name-based identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def parse(page: str, base: str) -> dict:
    """title, language, links (element, URL) and text: lines by block elements, white space collapsed, no scripts, styles or comments."""
    out, links, at, title, lang, in_title, in_head = [], [], 0, None, None, -1, False
    for m in TOKEN.finditer(page):
        if not in_head:
            out.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "title":
            if m["end"] and in_title >= 0:
                title, in_title = title or page[in_title : m.start()], -1
            elif not m["end"]:
                in_title = m.end()
        if tag in ("head", "body"):
            in_head = tag == "head" and not m["end"]
        elif tag not in HEAD and not m["end"]:
            in_head = False
        if not m["end"]:
            if tag == "html" or tag in LINKS:
                attrs = {a.lower(): html.unescape(x or y or z) for a, x, y, z in ATTR.findall(m["attrs"])}
                if tag == "html":
                    lang = lang or attrs.get("lang")
                elif attrs.get(LINKS[tag]):
                    try:
                        links.append((tag, urljoin(base, attrs[LINKS[tag]].strip())))
                    except ValueError:
                        links.append((tag, attrs[LINKS[tag]].strip()))
        if tag in BLOCK:
            out.append("\n")
    if not in_head:
        out.append(page[at:])
    text = "".join(re.sub(r"[^\S\n]+|\n", " ", s) if s != "\n" else s for s in out)
    text = html.unescape(text) if "&" in text else text
    lines = [" ".join(x.split()) for x in text.split("\n")]
    clean = lambda s: " ".join(html.unescape(s).split()) if s else None
    return {"title": clean(title), "language": lang, "links": links, "text": "\n".join(x for x in lines if x)}


RECORD_SCHEMA = (
    "page_id bigint, warc_type string, record_id string, refers_to string, linked_to string, target_uri string, warc_date string, content_type string, "
    "content_length bigint, block_digest string, source_block_digest string, source_payload_digest string, source_headers string, block binary"
)
RECORD_NAMES = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]


def derived(response: dict) -> list[tuple]:
    """The two records of a response (page_id, record_id, target_uri, warc_date, http_headers, payload)."""
    payload, uri, headers = response["payload"] or b"", response["target_uri"] or "", response["http_headers"] or ""
    source = digest(headers.encode() + CRLF + CRLF + payload), digest(payload)
    m = re.search(r"charset=[\"']?([\w-]+)", headers, re.I)
    try:
        page = payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    got = parse(page, uri)
    ids = {k: name(response["record_id"], k) for k in ("metadata", "conversion")}
    status = headers.split("\r\n", 1)[0]
    clean = lambda s: re.sub(r"[\r\n]+", " ", s)
    fields = [("title", got["title"]), ("language", got["language"]), ("http-status", status.split(" ")[1] if " " in status else None), ("source-payload-digest", source[1])]
    fields += [(f"http-header-{k.strip().lower()}", v.strip()) for k, _, v in (h.partition(":") for h in headers.split("\r\n")[1:]) if k]
    fields += [("outlink", f"{clean(url)} {tag}") for tag, url in got["links"]]
    meta = CRLF.join(f"{k}: {clean(v)}".encode("utf-8", "replace") for k, v in fields if v) + CRLF
    blocks = {"metadata": (meta, "application/warc-fields", "conversion"), "conversion": (got["text"].encode("utf-8", "replace"), "text/plain; charset=utf-8", "metadata")}
    return [
        (response["page_id"], kind, ids[kind], response["record_id"], ids[other], response["target_uri"], response["warc_date"], content, len(block), digest(block), *source, headers, block)
        for kind, (block, content, other) in blocks.items()
    ]


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64() if "bigint" in x else pa.binary() if "binary" in x else pa.string() for x in RECORD_SCHEMA.split(", ")]
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            rows = [r for x in b.slice(lo, 1000).to_pylist() for r in derived(x)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=RECORD_NAMES)


def derive(responses: DataFrame) -> DataFrame:
    """responses: page_id, record_id, target_uri, warc_date, http_headers, payload -> two records for each, as RECORD_SCHEMA."""
    text_batches(responses.sparkSession)
    return responses.select("page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload").mapInArrow(_derive, RECORD_SCHEMA)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages (page_id, url, html) as response records with name-based identifiers."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    h = F.sha1(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit("")), F.sha1(payload)).cast("binary"))
    part = lambda i, n: F.substring(h, i, n)
    urn = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), urn.alias("record_id"), F.col("url").cast("string").alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), payload.alias("payload"))


def serialised(records: DataFrame) -> DataFrame:
    """One column `value`: header, blank line, block and a CRLF; with the writer's CRLF after it that is a WARC/1.1 record."""

    def head(k: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(f"\r\n{k}: "), F.regexp_replace(c.cast("string"), r"[\r\n]+", " "))).otherwise(F.lit(""))

    names = {
        "WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Refers-To-Target-URI": "target_uri", "WARC-Refers-To-Date": "warc_date",
        "WARC-Concurrent-To": "linked_to", "WARC-Target-URI": "target_uri", "WARC-Date": "warc_date", "WARC-Block-Digest": "block_digest",
        "X-Source-Block-Digest": "source_block_digest", "X-Source-Payload-Digest": "source_payload_digest", "Content-Type": "content_type", "Content-Length": "content_length",
    }
    header = F.concat(F.lit("WARC/1.1"), *[head(k, F.col(c)) for k, c in names.items()], F.lit("\r\n\r\n"))
    return records.select(F.concat(header.cast("binary"), F.col("block"), F.lit("\r\n").cast("binary")).cast("string").alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    serialised(records).write.option("lineSep", "\r\n").option("compression", compression).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict, bytes, bool]]:
    """(headers, block, whole) of each record. Header names keep their case. A record that is cut off, or has no length, has the bytes up to the next
    record or the end and isn't whole."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        start = len(data) if end < 0 else end + 4
        lines = data[at : start].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}
        said = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
        if end >= 0 and said.isascii() and said.isdigit() and start + int(said) <= len(data):
            stop, whole = start + int(said), True
        else:
            more = data.find(b"\r\n\r\nWARC/1.", start)
            stop, whole = (len(data) if more < 0 else more), False
        yield headers, data[start:stop], whole
        at = max(stop, at + 1)


def unpacked(data: bytes) -> bytes:
    """Plain bytes of a file, in one gzip member or one for each record; of a cut-off member what there is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            out.append(z.decompress(data) + z.flush())
        except zlib.error:
            break
        data = z.unused_data
    return b"".join(out) if out else data


def read(spark: SparkSession, path: str) -> DataFrame:
    """headers map<string,string>, block binary, whole boolean of every record in the WARC files under path, whatever their names (plain or gzip). A file is
    a row at a time, so files must be under Spark's 2 GB for a row, as crawls' are, and a task holds one and its plain bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for b in batches:
            for data in b.column(0):
                rows = list(parsed(unpacked(data.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h, _, _ in rows], kind), pa.array([x for _, x, _ in rows], pa.binary()), pa.array([w for _, _, w in rows], pa.bool_())], names=["headers", "block", "whole"])

    text_batches(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "headers map<string,string>, block binary, whole boolean")


def op1(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Both records of every page; the block as text."""
    return derive(responses(pages)).withColumn("block", F.col("block").cast("string"))
