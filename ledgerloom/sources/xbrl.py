"""Inline XBRL: contexts, units and facts of filings as relations, joined in Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import Element, tree

FACTS = ("ix:nonfraction", "ix:nonnumeric")
CONTEXT = "context_id string, entity string, scheme string, period_start string, period_end string, instant string, dimensions array<struct<axis:string,member:string>>"
UNIT = "unit_id string, measures array<string>, numerator array<string>, denominator array<string>"
FACT = "fact_id string, concept string, context_id string, unit_id string, decimals string, scale int, sign string, raw_text string, value double"


def contexts_of(root: Element) -> list[dict]:
    """One for each xbrli:context; what is missing is empty."""

    def first(e: Element | None, tag: str) -> Element | None:
        found = e.all(tag) if e is not None else []
        return found[0] if found else None

    def said(e: Element | None) -> str:
        return e.text() if e is not None else ""

    out = []
    for c in root.all("xbrli:context"):
        who, when = first(c, "xbrli:identifier"), first(c, "xbrli:period")
        dims = []
        for s in c.all("xbrli:segment"):
            dims += [{"axis": m.attrs.get("dimension", ""), "member": m.text()} for m in s.all("xbrldi:explicitmember")]
            dims += [{"axis": m.attrs.get("dimension", ""), "member": next((x.text() for x in m.walk()), "")} for m in s.all("xbrldi:typedmember")]
        out.append({
            "context_id": c.attrs.get("id", ""), "entity": said(who), "scheme": who.attrs.get("scheme", "") if who is not None else "", "period_start": said(first(when, "xbrli:startdate")),
            "period_end": said(first(when, "xbrli:enddate")), "instant": said(first(when, "xbrli:instant")), "dimensions": dims,
        })
    return out


def units_of(root: Element) -> list[dict]:
    """Plain measures are direct children; a quotient has measures above and below."""
    out = []
    for u in root.all("xbrli:unit"):
        part = lambda tag: [m.text() for e in u.all(tag) for m in e.all("xbrli:measure")]  # noqa: E731, B023
        out.append({"unit_id": u.attrs.get("id", ""), "measures": [m.text() for m in u.children("xbrli:measure")], "numerator": part("xbrli:unitnumerator"), "denominator": part("xbrli:unitdenominator")})
    return out


def shown_number(text: str, sign: str | None) -> float | None:
    """The number as shown; a minus sign, the sign attribute or brackets make it negative; the scale isn't applied."""
    s = re.sub(r"[,\s]", "", text or "")
    negative = sign == "-" or s.startswith("(") and s.endswith(")")
    s = s.strip("()")
    negative = negative or s.startswith("-")
    s = s.lstrip("+-") if s[:1] in "+-" else s
    if not re.fullmatch(r"[0-9]+(\.[0-9]+)?", s):
        return None
    return -float(s) if negative else float(s)


def facts_of(root: Element) -> list[dict]:
    """Innermost facts in order."""
    out = []
    for f in root.all(*FACTS):
        if f.all(*FACTS):
            continue
        scale = f.attrs.get("scale", "")
        out.append({
            "fact_id": f.attrs.get("id", ""), "concept": f.attrs.get("name", ""), "context_id": f.attrs.get("contextref", ""), "unit_id": f.attrs.get("unitref", ""), "decimals": f.attrs.get("decimals", ""),
            "scale": int(scale) if re.fullmatch(r"[+-]?[0-9]+", scale) else 0, "sign": f.attrs.get("sign"), "raw_text": f.text(), "value": shown_number(f.text(), f.attrs.get("sign")),
        })
    return out


def _rows(of, key: str, html: str, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *[r[n] for n in names]) for k, page in zip(pdf[key], pdf[html]) for i, r in enumerate(of(tree(page)))]
            yield pd.DataFrame(rows, columns=[key, "position", *names])

    return run


def _table(pages: DataFrame, of, fields: str, key: str, html: str) -> DataFrame:
    names = [x.split()[0] for x in fields.split(", ")]
    return pages.select(key, html).mapInPandas(_rows(of, key, html, names), f"{key} {pages.schema[key].dataType.simpleString()}, position bigint, {fields}")


def contexts(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    return _table(pages, contexts_of, CONTEXT, key, html)


def units(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    return _table(pages, units_of, UNIT, key, html)


def facts(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """Facts with their contexts and units; `ingest.ingest` gives the same from one parse."""
    return resolved(_table(pages, facts_of, FACT, key, html), contexts(pages, key, html), units(pages, key, html), key)


def resolved(own: DataFrame, contexts: DataFrame, units: DataFrame, key: str = "doc_id") -> DataFrame:
    """Facts with their contexts and units, by left joins within a document; scaled = value * 10^scale. Of repeated context or unit ids the last counts."""
    last = lambda d, by: d.groupBy(key, by).agg(F.max_by(F.struct(*[c for c in d.columns if c not in (key, by, "position")]), "position").alias("x")).select(key, by, "x.*")
    out = own.join(last(contexts, "context_id"), [key, "context_id"], "left").join(last(units, "unit_id"), [key, "unit_id"], "left")
    return out.withColumn("scaled", F.col("value") * F.pow(F.lit(10.0), F.col("scale")))
