"""Filings written from the star schema and parsed again: a page for each customer, whose blocks, cells, facts and chunks SQL states from the tables alone.

A page has inline XBRL contexts, units and facts (nested, bracketed, with an unknown context), headings by element, wording and type, loose text, a script, and a
table with spans, two header rows, a scale, a percentage, a change and a footnote marker. Spark writes the pages; nothing of them is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations, facts, ingest, tables

CONTEXT = '<xbrli:context id="%s"><xbrli:entity><xbrli:identifier scheme="cik">%s</xbrli:identifier>%s</xbrli:entity><xbrli:period>%s</xbrli:period></xbrli:context>'
MEMBER = '<xbrli:segment><xbrldi:explicitMember dimension="us:SegmentAxis">us:{seg}</xbrldi:explicitMember></xbrli:segment>'
RATIO = '<xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide>'
PAGE = f"""<!DOCTYPE html><html><head><title>{{n}}</title></head><body><ix:header>
{CONTEXT % ("c1", "{k}", "", "<xbrli:startDate>{start}</xbrli:startDate><xbrli:endDate>{day}</xbrli:endDate>")}{CONTEXT % ("c2", "{k}", MEMBER, "<xbrli:instant>{day}</xbrli:instant>")}
<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id="per">{RATIO}</xbrli:unit></ix:header>
<p>PART I<h2>Item 1. Accounts of {{n}}</h2><p>{{n}} serves <ix:nonNumeric id="x" name="us:Segment" contextRef="zz">{{seg}}</ix:nonNumeric>.</p><script>var x = "<p>no</p>";</script>
<div>Loose <b>text</b> of nation {{nk}}<p>There are <ix:nonNumeric id="t" name="us:Text" contextRef="c1">some <ix:nonFraction id="o" name="us:Orders" contextRef="c1" unitRef="per" decimals="0">{{cnt}}</ix:nonFraction> orders</ix:nonNumeric> &amp; more.</p></div>
<table><caption>Accounts, in thousands</caption><tr><td></td><td colspan=2>{{head}}</td><td>{{iso}}</td></tr><tr><td></td><td>Net</td><td>%</td><td>Net</td></tr>
<tr><td>Balance (1)</td><td><ix:nonFraction id="b" name="us:Balance" contextRef="c2" unitRef="usd" decimals="2" scale="3">{{b}}</ix:nonFraction></td><td>5.5%</td><td>1,100</td></tr>
<tr><td rowspan=2>Orders</td><td>${{tot}}</td><td>{{cnt}}</td><td>3 bps</td></tr><tr><td>{{nk}}</td><td>x</td><td></td></tr></table>
<p style="font-weight:bold">Footnotes</p><p>(1) Unaudited.</p><h2>Item 2. Risks</h2><h3>Note 1 Orders</h3>{{none}}</body></html>"""


def filings(s, d):
    """(doc_id, html): a page for each customer, with the number and total of its orders."""
    t = lambda n: s.read.parquet(f"{d}/{n}.parquet")
    total = t("orders").groupBy("o_custkey").agg(F.count("*").alias("cnt"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("tot"))
    c = t("customer").join(total, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("c_custkey", F.lit(700)).cast("int")))
    shown, balance = F.format_number(F.abs("c_acctbal"), 2), F.col("c_acctbal")
    minus_zero = balance.cast("string") == "-0.0"  # shown with its sign, as SQL's format does
    own = {
        "k": F.col("c_custkey"), "n": F.col("c_name"), "seg": F.col("c_mktsegment"), "nk": F.col("c_nationkey"), "cnt": F.coalesce("cnt", F.lit(0)), "tot": F.format_number(F.coalesce("tot", F.lit(0).cast("decimal(22,2)")), 2),
        "b": F.when(balance < 0, F.concat(F.lit("("), shown, F.lit(")"))).when(minus_zero, F.concat(F.lit("-"), shown)).otherwise(shown), "day": F.col("day"), "start": F.date_sub("day", 89), "iso": F.date_sub("day", 366),
        "head": F.concat(F.lit("Three Months Ended "), F.date_format("day", "MMMM d, yyyy")), "none": F.when(F.col("cnt").isNull(), "<p>No orders.</p>").otherwise(""),
    }
    c = c.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "c_custkey")  # rows are small and parsing isn't
    pieces = PAGE.replace("}", "{").split("{")  # text and names in turn
    return c.select(F.col("c_custkey").alias("doc_id"), F.concat(*[own[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(pieces)]).alias("html"))


def _joined(df, *names):
    return df.withColumns({n: F.array_join(n, ",") for n in names})


def filing_blocks(s, d):
    rows = ingest.sectioned(ingest.filing_blocks(filings(s, d)))
    return _joined(rows, "fact_ids").select("doc_id", "position", "block_type", "text", "section", "n_cells", "n_period_cells", "fact_ids", "char_start", "char_end", "n_tokens")


def filing_cells(s, d):
    rows = _joined(ingest.part(ingest.parsed(filings(s, d)), "cell"), "footnotes", "fact_ids")
    return rows.select("doc_id", "table_no", "band", "row", "col", "label", "header", "raw_text", "value", "is_percent", "change_unit", "scale", "period_start", "period_end", "months", "footnotes", "caption", "fact_ids")


def filing_facts(s, d):
    own = ingest.ingest(filings(s, d))["facts"].withColumn("members", F.transform("dimensions", lambda x: F.concat_ws("=", x["axis"], x["member"])))
    out = own.select("doc_id", "position", "fact_id", "concept", "context_id", "unit_id", "decimals", "raw_text", "value", F.when(F.col("scaled") == 0, F.col("scaled")).otherwise(F.round("scaled", 2)).alias("scaled"), "entity", "period_start", "period_end", "instant", "members", "measures", "numerator", "denominator")
    return _joined(out, "members", "measures", "numerator", "denominator")


def filing_chunks(s, d):
    rows = ingest.ingest(filings(s, d))["chunks"]
    return _joined(rows, "fact_ids").select("doc_id", "chunk_no", "chunk_id", "block_type", "section", F.sha2(F.col("retrieval_text").cast("binary"), 256).alias("retrieval_sha256"), "n_tokens", "char_start", "char_end", "first_position", "last_position", "fact_ids", "prev_chunk_id", "next_chunk_id")


def filing_summary(s, d):
    return ingest.ingest(filings(s, d))["summary"]


def filing_cell_facts(s, d):
    """Facts tagged in cells, and whether both say the same."""
    out = ingest.ingest(filings(s, d))
    j = tables.cell_facts(out["cells"], out["facts"], "doc_id").select("*", F.explode("facts").alias("fact"))
    pairs = j.select(
        "doc_id", "row", "col", F.col("fact.concept").alias("concept"), F.col("value").alias("cell_value"), F.col("scale").alias("cell_scale"), F.col("period_end").alias("cell_end"), F.lit(None).cast("int").alias("cell_months"), F.lit("USD").alias("cell_unit"),
        F.col("fact.scaled").alias("fact_value"), F.coalesce("fact.instant", "fact.period_end").cast("date").alias("fact_end"), F.lit(None).cast("int").alias("fact_months"), F.element_at(F.split(F.col("fact.measures")[0], ":"), -1).alias("fact_unit"),
    )
    return facts.consistency(pairs).select("doc_id", "row", "col", "concept", "magnitude_ok", "sign_ok", "end_ok", "months_ok", "unit_ok", "consistent")


def filing_periods(s, d):
    """Starts of cells' durations from the contexts of their page."""
    own = ingest.ingest(filings(s, d))
    known = own["contexts"].select("doc_id", "context_id", *[F.to_date(F.nullif(c, F.lit(""))).alias(c) for c in ("period_start", "period_end")], F.size("dimensions").alias("n_dimensions"))
    return citations.start_from_contexts(own["cells"], known).select("doc_id", "row", "col", "period_start", "period_end", "months", "period_source")


QUERIES = {f.__name__: f for f in (filing_blocks, filing_cells, filing_facts, filing_chunks, filing_summary, filing_cell_facts, filing_periods)}

_C = """c AS (SELECT *, CASE WHEN c_acctbal < 0 THEN '(' || format('{:,.2f}', -c_acctbal) || ')' ELSE format('{:,.2f}', c_acctbal) END AS b, format('{:,.2f}', total) AS tot, 'Three Months Ended ' || strftime(day, '%B %-d, %Y') AS head, strftime(day - 366, '%Y-%m-%d') AS iso
  FROM (SELECT c_custkey AS doc_id, c_name AS n, c_mktsegment AS seg, c_nationkey AS nk, c_acctbal, coalesce(cnt, 0) AS cnt, coalesce(t, 0)::DOUBLE AS total, DATE '2020-01-01' + (c_custkey % 700)::INTEGER AS day
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS cnt, sum(o_totalprice::DECIMAL(12,2)) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey))"""
_ROWS = [  # kind, text, section, facts
    ("heading", "'PART I'", "''", ""), ("heading", "'Item 1. Accounts of ' || n", "' > Item 1. Accounts of ' || n", ""), ("paragraph", "n || ' serves ' || seg || '.'", "' > Item 1. Accounts of ' || n", "x"),
    ("paragraph", "'Loose text of nation ' || nk", "' > Item 1. Accounts of ' || n", ""), ("paragraph", "'There are some ' || cnt || ' orders & more.'", "' > Item 1. Accounts of ' || n", "o"),
    ("table", """concat_ws(chr(10), 'Table: Accounts, in thousands', 'Row: Balance (1)', '- ' || head || ' Net: ' || b, '- ' || head || ' %: 5.5%', '- ' || iso || ' Net: 1,100', 'Row: Orders', '- ' || head || ' Net: $' || tot,
      '- ' || head || ' %: ' || cnt, '- ' || iso || ' Net: 3 bps', 'Row: Orders', '- ' || head || ' Net: ' || nk)""", "' > Item 1. Accounts of ' || n", "b"),
    ("heading", "'Footnotes'", "' > Item 1. Accounts of ' || n || ' > Footnotes'", ""), ("paragraph", "'(1) Unaudited.'", "' > Item 1. Accounts of ' || n || ' > Footnotes'", ""),
    ("heading", "'Item 2. Risks'", "' > Item 2. Risks'", ""), ("heading", "'Note 1 Orders'", "' > Item 2. Risks > Note 1 Orders'", ""), ("paragraph", "'No orders.'", "' > Item 2. Risks > Note 1 Orders'", ""),
]
_BLOCKS = _C + ", raw AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i}::BIGINT AS position, '{kind}' AS block_type, {text} AS text, 'PART I' || {section} AS section, {7 if kind == 'table' else 0}::BIGINT AS n_cells, '{ids}' AS fact_ids FROM c{' WHERE cnt = 0' if i == 10 else ''}" for i, (kind, text, section, ids) in enumerate(_ROWS)
) + """), blocks AS (SELECT doc_id, position, block_type, text, section, n_cells, n_cells AS n_period_cells, fact_ids, coalesce(sum(length(text) + 1) OVER w, 0)::BIGINT AS char_start, length(text) AS len, len(string_split_regex(text, '\\s+'))::BIGINT AS n_tokens
  FROM raw WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_CELLS = _C + ", cells AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {row}::BIGINT AS row, {col}::BIGINT AS col, '{label}' AS label, {'iso' if col == 3 else 'head'} || ' {'%' if col == 2 else 'Net'}' AS header, {raw} AS raw_text, ({value})::DOUBLE AS value, {percent} AS is_percent, {change} AS change_unit, "
    f"{'NULL' if percent == 'true' or change != 'NULL' else 3}::INTEGER AS scale, ({'day - 366' if col == 3 else 'NULL'})::DATE AS period_start, ({'day - 366' if col == 3 else 'day'})::DATE AS period_end, {'NULL' if col == 3 else 3}::INTEGER AS months, '{'1' if row == 2 else ''}' AS footnotes, '{'b' if (row, col) == (2, 1) else ''}' AS fact_ids FROM c"
    for row, col, label, raw, value, percent, change in (
        (2, 1, "Balance (1)", "b", "round(c_acctbal, 2)", "false", "NULL"), (2, 2, "Balance (1)", "'5.5%'", "5.5", "true", "NULL"), (2, 3, "Balance (1)", "'1,100'", "1100", "false", "NULL"), (3, 1, "Orders", "'$' || tot", "total", "false", "NULL"),
        (3, 2, "Orders", "cnt::VARCHAR", "cnt", "false", "NULL"), (3, 3, "Orders", "'3 bps'", "3", "false", "'basis_point'"), (4, 1, "Orders", "nk::VARCHAR", "nk", "false", "NULL"),
    )
) + ")"
_CHUNKS = _BLOCKS + """, g AS (SELECT *, CASE position WHEN 0 THEN 0 WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 3 WHEN 8 THEN 4 WHEN 9 THEN 5 WHEN 10 THEN 5 ELSE 1 END::BIGINT AS chunk_no FROM blocks),
k AS (SELECT doc_id, chunk_no, CASE WHEN chunk_no = 2 THEN 'table' WHEN bool_and(block_type = 'heading') THEN 'heading' ELSE 'text' END AS block_type, arg_min(section, position) AS section, string_agg(text, chr(10) || chr(10) ORDER BY position) AS text,
  sum(n_tokens)::BIGINT AS n_tokens, min(char_start)::BIGINT AS char_start, max(char_start + len)::BIGINT AS char_end, min(position) AS first_position, max(position) AS last_position, coalesce(string_agg(nullif(fact_ids, ''), ',' ORDER BY position), '') AS fact_ids FROM g GROUP BY doc_id, chunk_no),
i AS (SELECT *, substr(sha256(concat_ws(':', doc_id, first_position, char_start, char_end, '')), 1, 16) AS chunk_id FROM k)"""
ORACLES = {
    "filing_blocks": f"WITH {_BLOCKS} SELECT * EXCLUDE (len), char_start + len AS char_end FROM blocks",
    "filing_cells": f"WITH {_CELLS} SELECT *, 0::BIGINT AS table_no, 0::BIGINT AS band, 'Accounts, in thousands' AS caption FROM cells",
    "filing_facts": f"""WITH {_C} SELECT doc_id, 0::BIGINT AS position, 'x' AS fact_id, 'us:Segment' AS concept, 'zz' AS context_id, '' AS unit_id, '' AS decimals, seg AS raw_text, NULL::DOUBLE AS value, NULL::DOUBLE AS scaled, NULL::VARCHAR AS entity,
  NULL::VARCHAR AS period_start, NULL::VARCHAR AS period_end, NULL::VARCHAR AS instant, NULL::VARCHAR AS members, NULL::VARCHAR AS measures, NULL::VARCHAR AS numerator, NULL::VARCHAR AS denominator FROM c
UNION ALL SELECT doc_id, 1, 'o', 'us:Orders', 'c1', 'per', '0', cnt::VARCHAR, cnt, cnt, doc_id::VARCHAR, (day - 89)::VARCHAR, day::VARCHAR, '', '', '', 'iso4217:USD', 'xbrli:shares' FROM c
UNION ALL SELECT doc_id, 2, 'b', 'us:Balance', 'c2', 'usd', '2', b, c_acctbal, round(c_acctbal * 1000, 2), doc_id::VARCHAR, '', '', day::VARCHAR, 'us:SegmentAxis=us:' || seg, 'iso4217:USD', '', '' FROM c""",
    "filing_chunks": f"""WITH {_CHUNKS} SELECT doc_id, chunk_no, chunk_id, block_type, section, sha256(section || chr(10) || text) AS retrieval_sha256, n_tokens, char_start, char_end, first_position, last_position, fact_ids, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id
FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)""",
    "filing_summary": f"WITH {_C} SELECT (count(*) * 10 + count(CASE WHEN cnt = 0 THEN 1 END))::BIGINT AS blocks, count(*) AS tables, (count(*) * 7)::BIGINT AS period_cells, (count(*) * 3)::BIGINT AS facts, count(*) AS documents, (count(*) * 6)::BIGINT AS chunks FROM c",
    "filing_cell_facts": f"WITH {_C} SELECT doc_id, 2::BIGINT AS row, 1::BIGINT AS col, 'us:Balance' AS concept, true AS magnitude_ok, true AS sign_ok, true AS end_ok, true AS months_ok, true AS unit_ok, true AS consistent FROM c",
    "filing_periods": f"WITH {_CELLS} SELECT doc_id, row, col, CASE WHEN col = 3 THEN period_start ELSE period_end - 89 END AS period_start, period_end, months, CASE WHEN col < 3 THEN 'c1' END AS period_source FROM cells",
}
