"""Queries on the driver's tables for operators written as DataFrames, with DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks, calculator, dense, fusion, lexical, metrics, provenance, runtime, stored
from ..sources import canonical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _queries(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("query"))


def _long(df, *cols):
    return df.select(*[F.col(c).cast("long").alias(c) if c in ("rank", "n", "df", "cf", "k") else F.col(c) for c in cols])


# --- lexical


def bm25_index_build(s, d):
    """Builds the written index anew: what the first of the other queries pays. Its postings, by document."""
    index = lexical.Index.build(table(s, d, "documents"))
    return index.postings().groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").cast("long").alias("n_tokens"), F.max("dl").cast("long").alias("dl"))


def bm25_topk(s, d):
    return _long(lexical.index_of(table(s, d, "documents")).search(_queries(s, d), 10), "q_id", "doc_id", "score", "rank")


def bm25_filtered_topk(s, d):
    docs = table(s, d, "documents")
    return _long(lexical.index_of(docs).search(_queries(s, d), 10, docs.filter("lang = 'en'")), "q_id", "doc_id", "score", "rank")


def bm25_index_stats(s, d):
    out = lexical.index_of(table(s, d, "documents")).statistics()
    return out.select("n", F.round("avgdl", 6).alias("avgdl"), "min_dl", "max_dl", "vocabulary", "postings")


def term_df_top(s, d):
    return _long(lexical.top_terms(lexical.index_of(table(s, d, "documents")), 50), "term", "df", "cf")


#: Tokens without look-around and NFKC, which the tables need for no text; casefold's one change beyond lower-casing here is of sharp s.
_FOLD = "replace(translate(lower(coalesce(text, '')), '‐‑‒–—−‘’', '------' || chr(39) || chr(39)), 'ß', 'ss')"
_LEX = r"""list_transform(regexp_extract_all({x}, '[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?%?|[\p{L}\p{N}]+(?:[-/''][\p{L}\p{N}]+)*(?:\.[0-9]+)?%?'), lambda x: replace(x, ',', ''))""".replace("{x}", _FOLD)
TOKENS = f"""toks AS (SELECT doc_id, lang, {_LEX} AS t FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY doc_id, term),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl, min(len(t)) AS min_dl, max(len(t)) AS max_dl FROM toks)"""
BM25 = (
    TOKENS
    + ",\nq AS (SELECT DISTINCT item_id AS q_id, unnest(" + _LEX + ") AS term FROM benchmark),"
    + r"""
dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
scored AS (SELECT q.q_id, p.doc_id, round(sum(ln(1 + (st.n - dfs.df + 0.5) / (dfs.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / st.avgdl))), 6) AS score
  FROM q JOIN post p ON p.term = q.term JOIN dfs ON dfs.term = q.term JOIN toks ON toks.doc_id = p.doc_id CROSS JOIN st WHERE {where} GROUP BY q.q_id, p.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""
)
BM25_SQL = "WITH " + BM25 + " SELECT q_id, doc_id, score, rank FROM ranked WHERE rank <= 10"


# --- dense: every vector whose id is divisible by 50 is a query


def _vector_queries(vectors):
    return vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_embedding"))


def _vectors(s, d) -> dense.VectorIndex:
    """The written index of the embeddings; their values are hashed in every call, so an index of other ones is never taken."""
    v = table(s, d, "embeddings")
    return stored.kept(v, "vectors", ("vec_id", "embedding", "label"), lambda: dense.VectorIndex.build(v, keep=("label",)))


def _dense(s, d, k=10, where=None):
    return _vectors(s, d).search(_vector_queries(table(s, d, "embeddings")), k, where)


def dense_topk(s, d):
    return _long(_dense(s, d), "q_id", "vec_id", "score", "rank")


def dense_filtered_topk(s, d):
    return _long(_dense(s, d, where=lambda r: r["label"] % 2 == 0), "q_id", "vec_id", "score", "rank")


def dense_batch(s, d):
    """Every query vector with the number of its results, those without a direction too."""
    q = _vector_queries(table(s, d, "embeddings"))
    none = q.select((-1 - F.col("q_id")).alias("q_id"), F.transform("q_embedding", lambda x: x * 0).alias("q_embedding"))
    got = _vectors(s, d).run(q.unionByName(none), 20)
    say = F.array_join(F.transform("ranked_results", lambda r: F.concat(r["rank"].cast("string"), F.lit(":"), r["vec_id"].cast("string"))), ",")
    return got.select("q_id", F.col("n_results").cast("long").alias("n_results"), F.sha2(say.cast("binary"), 256).alias("fingerprint"))


def vector_index_build(s, d):
    """Builds the written index anew and reports on its blocks."""
    blocks = dense.VectorIndex.build(table(s, d, "embeddings"), keep=("label",)).blocks()
    return blocks.agg(F.sum("n").alias("n"), F.max("dim").alias("dim"), F.sum("n_vectors").alias("n_vectors"))


def embedding_norms(s, d):
    return dense.checked_norms(table(s, d, "embeddings"))


def dense_score_distribution(s, d):
    return dense.score_distribution(_dense(s, d, 50))


DENSE = """qv AS (SELECT vec_id AS q_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
sc AS (SELECT q_id, vec_id, label, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS score,
  round(list_dot_product(embedding::DOUBLE[], q), 6) AS dot FROM embeddings CROSS JOIN qv WHERE {where}),
da AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM sc) WHERE rank <= {k})"""


# --- fusion: cosine and dot product as two systems


def _systems(s, d, depth=50):
    v = table(s, d, "embeddings")
    q = _vector_queries(v)
    index = _vectors(s, d)
    return index.search(q, depth), index.search(q, depth, cosine=False)


def rrf_fusion(s, d):
    return _long(fusion.rrf(*_systems(s, d), key="vec_id"), "q_id", "vec_id", "score", "rank")


def candidate_union(s, d):
    u = fusion.candidate_union(*_systems(s, d), key="vec_id")
    return u.select("q_id", "vec_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("rank_a", "rank_b")], "score_a", "score_b", "rrf")


def overlap_diagnostics(s, d):
    return fusion.overlap(fusion.candidate_union(*_systems(s, d, 20), key="vec_id"))


def rerank_topk(s, d):
    u = fusion.candidate_union(*_systems(s, d), key="vec_id").join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id")
    out = fusion.rerank(u, lambda c: F.coalesce(F.col("score_a"), F.lit(0.0)) - 0.01 * F.col("label"), 10, key="vec_id")
    return _long(out, "q_id", "vec_id", "score", "rank")


def rank_contiguity_check(s, d):
    out = fusion.rank_defects(_dense(s, d, 50), 50, key="vec_id")
    return out.select("q_id", "n", "low", "high", "ok")


def corpus_identity_check(s, d):
    """Ranked candidates must agree with the corpus row in every identity field; claims of every seventh vector are off by one, every eleventh is no vector."""
    v = table(s, d, "embeddings").select("vec_id", "label")
    claim = F.when(F.col("vec_id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label"))
    ranked = _dense(s, d).join(v.select("vec_id", claim.alias("label")), "vec_id").withColumn("vec_id", F.when(F.col("vec_id") % 11 == 0, -F.col("vec_id") - 1).otherwise(F.col("vec_id")))
    merged = fusion.merged_metadata(ranked.select("vec_id", "label").distinct(), v, "vec_id", ["label"]).select("vec_id", (F.size("conflicts") > 0).alias("bad"))
    known = ranked.join(v.select("vec_id", F.lit(True).alias("known")), "vec_id", "left").join(merged, "vec_id", "left")
    return known.groupBy("q_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("known").isNull(), 1)).alias("n_unknown"), F.count(F.when(F.col("known") & F.col("bad"), 1)).alias("n_conflicts"))


def rank_sentinel(s, d):
    return fusion.sentinel(_dense(s, d), key="vec_id")


def score_defects(s, d):
    """A ranking whose scores lack every fifth candidate, repeat every seventh and have one of a stranger."""
    r = _dense(s, d).select("q_id", "vec_id", "score")
    scores = r.filter("vec_id % 5 <> 0").unionByName(r.filter("vec_id % 7 = 0 AND vec_id % 5 <> 0")).unionByName(r.filter("vec_id % 5 = 0").select("q_id", (-F.col("vec_id") - 1).alias("vec_id"), "score"))
    return fusion.score_defects(r, scores, key="vec_id")


def truncation_summary(s, d):
    return dense.truncation(table(s, d, "conversations"), T.token_count(F.col("text")), 32)


def vector_metadata(s, d):
    return dense.metadata(table(s, d, "embeddings")).select("n", "min_dim", "max_dim", "n_directed")


def bm25_batch(s, d):
    """Every passage with the number of its results, the empty ones too."""
    q = _queries(s, d).unionByName(s.createDataFrame([(-1, "zzzunknownterm"), (-2, "")], "q_id long, query string"))
    got = lexical.index_of(table(s, d, "documents")).run(q, 50)
    return got.select("q_id", F.col("n_results").cast("long").alias("n_results"), F.try_element_at("ranked_results", F.lit(1))["doc_id"].alias("best"))


def compared_systems(s, d):
    return metrics.compared(metrics.evidence_metrics(_first(s, d)), ["cosine", "dot"], ["part_recall", "item_coverage", "weighted_strict"])


_TWO = DENSE.format(where="true", k=50) + ", db AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dot DESC, vec_id) AS rank FROM sc) WHERE rank <= 50)"
_UNION = _TWO + """, un AS (SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.vec_id, b.vec_id) AS vec_id, a.rank AS rank_a, b.rank AS rank_b, a.score AS score_a, b.dot AS score_b,
  round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf FROM da a FULL OUTER JOIN db b ON a.q_id = b.q_id AND a.vec_id = b.vec_id)"""


# --- evaluation


def _gold(s, d):
    """A query's evidence: vectors of its label; five items of two parts, whose vectors are alternatives."""
    v = table(s, d, "embeddings")
    q = v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("q_id"), "label")
    item = F.col("vec_id") % 5
    importance = F.when(item == 0, "core").when(item <= 2, "supporting").otherwise("optional")
    return v.join(q, "label").select("q_id", item.alias("item_id"), (F.floor(F.col("vec_id") / 5).cast("long") % 2).alias("part_id"), importance.alias("importance"), F.col("vec_id").alias("key"))


def _first(s, d):
    a, b = _systems(s, d)
    named = lambda x, n: x.select(F.lit(n).alias("system"), "q_id", F.col("vec_id").alias("key"), "rank")
    return metrics.first_ranks(named(a, "cosine").unionByName(named(b, "dot")), _gold(s, d))


_GOLD = _TWO + """, gold AS (SELECT q.vec_id AS q_id, e.vec_id % 5 AS item_id, (e.vec_id // 5) % 2 AS part_id, CASE WHEN e.vec_id % 5 = 0 THEN 'core' WHEN e.vec_id % 5 <= 2 THEN 'supporting' ELSE 'optional' END AS importance, e.vec_id AS key
  FROM embeddings e JOIN embeddings q ON e.label = q.label AND q.vec_id % 50 = 0),
rk AS (SELECT 'cosine' AS system, q_id, vec_id AS key, rank FROM da UNION ALL SELECT 'dot', q_id, vec_id, rank FROM db),
fr AS (SELECT p.*, f.first_rank FROM (SELECT DISTINCT system, g.q_id, item_id, part_id, importance FROM gold g CROSS JOIN (SELECT DISTINCT system FROM rk)) p
  LEFT JOIN (SELECT system, g.q_id, item_id, part_id, min(rank) AS first_rank FROM gold g JOIN rk ON rk.q_id = g.q_id AND rk.key = g.key GROUP BY ALL) f USING (system, q_id, item_id, part_id)),
ks AS (SELECT unnest([1, 3, 5, 10, 20, 50])::BIGINT AS k),
it AS (SELECT system, q_id, item_id, importance, k, count(*) AS parts, count(CASE WHEN first_rank <= k THEN 1 END) AS hits, CASE importance WHEN 'core' THEN 3.0 WHEN 'supporting' THEN 1.5 ELSE 0.5 END::DOUBLE AS w FROM fr CROSS JOIN ks GROUP BY ALL),
it2 AS (SELECT *, hits::DOUBLE / parts AS coverage, hits = parts AS all_parts FROM it)"""
_PANEL = """count(*)::BIGINT AS n_items, sum(parts)::BIGINT AS n_parts, round(sum(hits)::DOUBLE / sum(parts), 9) AS part_recall, round(avg(coverage), 9) AS item_coverage, round(avg(all_parts::INT), 9) AS all_parts_rate,
round(sum(w * all_parts::INT) / sum(w), 9) AS weighted_strict, round(sum(w * coverage) / sum(w), 9) AS weighted_partial,
round(sum(CASE WHEN importance = 'core' THEN hits END)::DOUBLE / sum(CASE WHEN importance = 'core' THEN parts END), 9) AS core_recall, count(CASE WHEN hits = 0 THEN 1 END)::BIGINT AS zero_hit_items"""
_MISS = _GOLD + """, ms AS (SELECT system, q_id, item_id, k, count(*) AS parts, count(CASE WHEN first_rank <= k THEN 1 END) AS hits, min(CASE WHEN first_rank > k THEN first_rank END) AS first_below
  FROM fr CROSS JOIN (SELECT unnest([10, 50])::BIGINT AS k) GROUP BY ALL HAVING hits < parts),
ml AS (SELECT *, CASE WHEN hits > 0 AND parts > 1 AND first_below <= 50 THEN 'partial_hit;below_k' WHEN hits > 0 AND parts > 1 THEN 'partial_hit' WHEN first_below <= 50 THEN 'below_k' ELSE 'not_retrieved' END AS labels FROM ms)"""


def evidence_metrics_at_k(s, d):
    return metrics.evidence_metrics(_first(s, d))


def per_question_metrics(s, d):
    return metrics.per_question(_first(s, d)).withColumn("q_id", F.coalesce("q_id", F.lit(-1).cast("long")))


def numeric_metrics_at_k(s, d):
    return metrics.numeric_metrics(_first(s, d), F.col("item_id") % 2)


def part_mrr(s, d):
    return metrics.mrr(_first(s, d))


def first_hit_histogram(s, d):
    return metrics.first_hit_histogram(_first(s, d))


def miss_diagnostics(s, d):
    return metrics.misses(_first(s, d)).select("system", "q_id", "item_id", "k", "parts", "hits", F.coalesce("first_below", F.lit(-1).cast("long")).alias("first_below"), "labels")


def failure_counts(s, d):
    return metrics.failure_counts(metrics.misses(_first(s, d)))


def system_comparison(s, d):
    return metrics.comparison(metrics.evidence_metrics(_first(s, d)), "cosine", "dot", ["part_recall", "item_coverage", "weighted_strict"])


# --- blocks and chunks


def paragraphs_with_offsets(s, d):
    return blocks.paragraphs(table(s, d, "documents")).select("doc_id", "position", "char_start", "char_end", "n_tokens", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def section_forward_fill(s, d):
    p = blocks.paragraphs(table(s, d, "documents"))
    out = blocks.section_paths(p, F.length("text") <= 40)
    return out.select("doc_id", "position", "is_heading", "section")


def prev_next_links(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("chunk_id"))
    return blocks.linked(c, "conv_id", "turn")


def token_counts(s, d):
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", T.token_count(F.col("text")).alias("n_tokens"))


def chunk_ids(s, d):
    p = blocks.paragraphs(table(s, d, "documents"))
    return p.select("doc_id", "position", blocks.chunk_id(F.col("doc_id"), F.col("position"), F.col("char_start"), F.col("char_end"), F.lit("")).alias("chunk_id"))


def greedy_chunks(s, d):
    return blocks.greedy_chunks(blocks.paragraphs(table(s, d, "documents")))


def row_group_split(s, d):
    out = blocks.row_groups(table(s, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.groupBy("l_suppkey", F.col("suffix").cast("long").alias("suffix")).agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


_PARAGRAPHS = r"""pr AS (SELECT doc_id, i - 1 AS position, lines[i] AS text FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
pa AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start,
  len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM pr)"""


def page_blocks(s, d):
    return blocks.page_blocks(table(s, d, "pages"))


def page_headings(s, d):
    return blocks.page_blocks(table(s, d, "pages")).filter("block_type = 'heading'").select("page_id", "position", "text")


def page_title(s, d):
    """Titles by pattern, white space collapsed."""
    t = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return table(s, d, "pages").select("page_id", F.trim(F.regexp_replace(t, "[ \\t\\n\\r]+", " ")).alias("title"), F.regexp_count("html", F.lit(r"<a [^>]*href=")).cast("long").alias("n_links"))


def page_text_stats(s, d):
    b = blocks.page_blocks(table(s, d, "pages"))
    return b.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"), F.max("char_end").alias("char_end"))


def outline_paths(s, d):
    """The heading state machine over synthetic headings: an order's priority is its part, its status an item."""
    o = table(s, d, "orders")
    say = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("PART "), F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "III")]), (F.col("o_orderkey") % 3 + 1).cast("int"))))
    say = say.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Item "), (F.col("o_orderkey") % 9).cast("string"), F.lit("."))).otherwise(F.lit("text"))
    out = blocks.outline(o.select("o_custkey", F.col("o_orderkey").alias("position"), say.alias("text")), "o_custkey")
    return out.select("o_custkey", "position", "part", "item", "path")


# --- numbers


def unit_scale_detect(s, d):
    t = table(s, d, "customer").select("c_custkey", F.concat(F.lit("in "), F.element_at(F.array(F.lit("Thousands"), F.lit("millions of USD"), F.lit("billion, not million"), F.lit("USD")), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("t"))
    return t.select("c_custkey", F.coalesce(T.unit_scale(F.col("t")), F.lit(0)).alias("scale"))


def percent_cells(s, d):
    """Cells as text read back as numbers: percent, brackets for negatives, commas, change units."""
    v = F.col("l_discount") * 100
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("("), F.format_string("%.1f", v), F.lit("%)"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.format_string("%.1f", v), F.lit(" pp"))).otherwise(F.concat(F.lit("$1,"), F.lpad(F.format_string("%.0f", F.col("l_quantity")), 3, "0")))
    n = T.parsed_number(raw)
    t = table(s, d, "lineitem").select(n.alias("n"))
    return t.groupBy("n.is_percent", "n.is_negative", "n.has_comma", "n.change_unit").agg(F.count("*").alias("n"), F.round(F.sum("n.value"), 3).alias("total"))


def formula_eval(s, d):
    """A formula compiled to a column."""
    expr = calculator.compiled("price * (1 - discount) * (1 + tax) / -quantity", {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax"), "quantity": F.col("l_quantity")})
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", expr.alias("result"))


# --- provenance


def passage_provenance(s, d):
    return provenance.passages_in(table(s, d, "documents"), table(s, d, "benchmark"))


def min_hitting_set(s, d):
    gold = table(s, d, "lineitem").select(F.col("l_suppkey"), F.col("l_returnflag").alias("part"), (F.col("l_partkey") % 7).alias("alternative"))
    got = provenance.hitting_sets(gold, "l_suppkey", "part", "alternative")
    return got.select("l_suppkey", "n_parts", F.array_join("chosen", ",").alias("chosen"))


def corpus_fingerprint(s, d):
    h = table(s, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return canonical.corpus_fingerprint(h, "h", "0.1.1")


def lexical_tokens(s, d):
    """Tokens after NFKC and casefold."""
    t = T.lexical(F.col("text"))
    return table(s, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " ").cast("binary"), 256).alias("fingerprint"))


# --- runtime


def tool_registry(s, d) -> runtime.Registry:
    r = runtime.Registry()
    r.register(runtime.Operation("calculator", "calculate", calculator.evaluate, {"text": {"type": "string", "required": True}, "bindings": {"type": "object", "required": True}}))

    def search(query: str, top_k: int) -> list[dict]:
        q = s.createDataFrame([(0, query)], "q_id long, query string")
        return [r.asDict() for r in lexical.index_of(table(s, d, "documents")).search(q, top_k).orderBy("rank").collect()]

    r.register(runtime.Operation("retrieval", "search", search, {"query": {"type": "string", "required": True, "pattern": r"(?s).*\S.*"}, "top_k": {"type": "integer", "default": 10, "minimum": 1, "maximum": 50}}))
    return r


def _calls(s, d):
    r = tool_registry(s, d)
    r.invoke("c1", "calculator", "calculate", {"text": "a / b", "bindings": {"a": "1", "b": "3"}})
    r.invoke("c2", "calculator", "calculate", {"text": "a ** b", "bindings": {"a": "1", "b": "3"}})
    r.invoke("c3", "retrieval", "search", {"query": "the", "top_k": 3})
    r.invoke("c4", "retrieval", "search", {"query": "the", "top_k": 99})
    r.invoke("c5", "nothing", "here", {})
    return r


def tool_invoke_envelope(s, d):
    rows = [(e["call_id"], e["status"], (e["error"] or {}).get("kind"), canonical.canonical_json(e["result"])) for e in _calls(s, d).ledger]
    return s.createDataFrame(rows, "call_id string, status string, error_kind string, result string")


def ledger_hash(s, d):
    return s.createDataFrame([(e["position"], e["call_id"], e["hash"]) for e in _calls(s, d).ledger], "position long, call_id string, hash string")


QUERIES = {f.__name__: f for f in (
    bm25_index_build, bm25_topk, bm25_filtered_topk, bm25_index_stats, term_df_top, dense_topk, dense_filtered_topk, dense_batch, vector_index_build, embedding_norms, dense_score_distribution, rrf_fusion, candidate_union, overlap_diagnostics, rerank_topk,
    rank_contiguity_check, corpus_identity_check, rank_sentinel, score_defects, truncation_summary, vector_metadata, bm25_batch, compared_systems, evidence_metrics_at_k, per_question_metrics, numeric_metrics_at_k, part_mrr, first_hit_histogram, miss_diagnostics, failure_counts, system_comparison,
    paragraphs_with_offsets, section_forward_fill, prev_next_links, token_counts, chunk_ids, greedy_chunks, row_group_split, page_blocks, page_headings, page_title, page_text_stats, outline_paths,
    unit_scale_detect, percent_cells, formula_eval, passage_provenance, min_hitting_set, corpus_fingerprint, lexical_tokens, tool_invoke_envelope, ledger_hash,
)}

ORACLES = {
    "bm25_index_build": "WITH " + TOKENS + " SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, max(dl)::BIGINT AS dl FROM post GROUP BY doc_id",
    "bm25_topk": BM25_SQL.replace("{where}", "true"),
    "bm25_filtered_topk": BM25_SQL.replace("{where}", "toks.lang = 'en'"),
    "bm25_index_stats": "WITH " + TOKENS + " SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl, min_dl::BIGINT AS min_dl, max_dl::BIGINT AS max_dl, (SELECT count(DISTINCT term) FROM post) AS vocabulary, (SELECT count(*) FROM post) AS postings FROM st",
    "term_df_top": "WITH " + TOKENS + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term ORDER BY df DESC, term LIMIT 50",
    "dense_topk": "WITH " + DENSE.format(where="true", k=10) + " SELECT q_id, vec_id, score, rank FROM da",
    "dense_filtered_topk": "WITH " + DENSE.format(where="label % 2 = 0", k=10) + " SELECT q_id, vec_id, score, rank FROM da",
    "dense_batch": "WITH " + DENSE.format(where="true", k=20) + ", r AS (SELECT q_id, count(*) AS n, string_agg(rank::VARCHAR || ':' || vec_id::VARCHAR, ',' ORDER BY rank) AS t FROM da GROUP BY q_id) SELECT q_id, n AS n_results, sha256(t) AS fingerprint FROM r UNION ALL SELECT -1 - vec_id, 0, sha256('') FROM embeddings WHERE vec_id % 50 = 0",
    "vector_index_build": "SELECT count(*) AS n, max(len(embedding))::INT AS dim, count(embedding) AS n_vectors FROM embeddings",
    "embedding_norms": "SELECT vec_id, len(embedding)::BIGINT AS dim, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) > 0 AS valid FROM embeddings",
    "dense_score_distribution": "WITH " + DENSE.format(where="true", k=50) + " SELECT count(*) AS n, min(score) AS min_score, round(quantile_cont(score, 0.5), 6) AS median_score, max(score) AS max_score FROM da",
    "rrf_fusion": "WITH " + _UNION + " SELECT q_id, vec_id, rrf AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rrf DESC, vec_id) AS rank FROM un) WHERE rank <= 50",
    "candidate_union": "WITH " + _UNION + " SELECT q_id, vec_id, coalesce(rank_a, 0)::BIGINT AS rank_a, coalesce(rank_b, 0)::BIGINT AS rank_b, score_a, score_b, rrf FROM un",
    "overlap_diagnostics": "WITH " + _UNION.replace("rank <= 50", "rank <= 20") + " SELECT q_id, count(*) AS n_union, count(CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN 1 END) AS n_both, count(CASE WHEN rank_b IS NULL THEN 1 END) AS n_only_a, count(CASE WHEN rank_a IS NULL THEN 1 END) AS n_only_b, round(100.0::DOUBLE * count(CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN 1 END) / count(*), 6) AS overlap_pct FROM un GROUP BY q_id",
    "rerank_topk": "WITH " + _UNION + ", rr AS (SELECT un.q_id, un.vec_id, round(coalesce(score_a, 0) - 0.01::DOUBLE * e.label, 6) AS score FROM un JOIN embeddings e ON e.vec_id = un.vec_id) SELECT q_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM rr) WHERE rank <= 10",
    "rank_contiguity_check": "WITH " + DENSE.format(where="true", k=50) + " SELECT q_id, count(*) AS n, min(rank) AS low, max(rank) AS high, min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AND count(DISTINCT vec_id) = count(*) AND count(*) <= 50 AS ok FROM da GROUP BY q_id",
    "corpus_identity_check": "WITH " + DENSE.format(where="true", k=10) + " SELECT q_id, count(*) AS n, count(CASE WHEN vec_id % 11 = 0 THEN 1 END) AS n_unknown, count(CASE WHEN vec_id % 11 <> 0 AND vec_id % 7 = 0 THEN 1 END) AS n_conflicts FROM da GROUP BY q_id",
    "rank_sentinel": "WITH " + DENSE.format(where="true", k=10) + " SELECT q_id, sha256(string_agg(rank::VARCHAR || ':' || vec_id::VARCHAR, ',' ORDER BY rank)) AS fingerprint FROM da GROUP BY q_id",
    "score_defects": "WITH " + DENSE.format(where="true", k=10) + " SELECT q_id, vec_id, 'no_score' AS defect FROM da WHERE vec_id % 5 = 0 UNION ALL SELECT q_id, -vec_id - 1, 'no_candidate' FROM da WHERE vec_id % 5 = 0 UNION ALL SELECT q_id, vec_id, 'scored_twice' FROM da WHERE vec_id % 5 <> 0 AND vec_id % 7 = 0",
    "truncation_summary": r"WITH t AS (SELECT len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM conversations) SELECT count(*) AS n_texts, count(CASE WHEN n > 32 THEN 1 END) AS n_over, round(100.0 * count(CASE WHEN n > 32 THEN 1 END) / count(*), 6) AS pct_over, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS longest FROM t",
    "vector_metadata": "SELECT count(*) AS n, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim, count(CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 THEN 1 END) AS n_directed FROM embeddings",
    "bm25_batch": BM25_SQL.replace("{where}", "true").replace("SELECT q_id, doc_id, score, rank FROM ranked WHERE rank <= 10", "SELECT item_id AS q_id, count(r.rank) AS n_results, min(CASE WHEN r.rank = 1 THEN r.doc_id END) AS best FROM benchmark LEFT JOIN (SELECT * FROM ranked WHERE rank <= 50) r ON r.q_id = item_id GROUP BY item_id UNION ALL VALUES (-1, 0, NULL), (-2, 0, NULL)"),
    "compared_systems": "WITH " + _GOLD + ", pn AS (SELECT system, k, " + _PANEL + " FROM it2 GROUP BY system, k), lg AS (UNPIVOT pn ON part_recall, item_coverage, weighted_strict INTO NAME metric VALUE v) SELECT a.k, a.metric, a.v AS cosine, b.v AS dot, round(b.v - a.v, 9) AS dot_minus_cosine FROM lg a JOIN lg b ON a.k = b.k AND a.metric = b.metric AND a.system = 'cosine' AND b.system = 'dot'",
    "evidence_metrics_at_k": "WITH " + _GOLD + " SELECT system, k, " + _PANEL + " FROM it2 GROUP BY system, k",
    "per_question_metrics": "WITH " + _GOLD + " SELECT system, k, coalesce(q_id, -1)::BIGINT AS q_id, " + _PANEL + " FROM it2 GROUP BY GROUPING SETS ((system, k, q_id), (system, k))",
    "numeric_metrics_at_k": "WITH " + _GOLD + """, gr AS (SELECT system, k, q_id, item_id % 2 AS g, max(all_parts::INT) AS ok FROM it2 GROUP BY ALL), qs AS (SELECT system, k, q_id, min(ok) AS ok FROM gr GROUP BY ALL)
SELECT a.system, a.k, a.strict_fact_coverage, a.multi_input_strict_rate, a.mean_input_coverage, b.group_coverage, c.complete_question_rate FROM (SELECT system, k, round(avg(all_parts::INT), 9) AS strict_fact_coverage, round(avg(CASE WHEN parts > 1 THEN all_parts::INT END), 9) AS multi_input_strict_rate, round(avg(CASE WHEN parts > 1 THEN coverage END), 9) AS mean_input_coverage FROM it2 GROUP BY ALL) a
JOIN (SELECT system, k, round(avg(ok), 9) AS group_coverage FROM gr GROUP BY ALL) b USING (system, k) JOIN (SELECT system, k, round(avg(ok), 9) AS complete_question_rate FROM qs GROUP BY ALL) c USING (system, k)""",
    "part_mrr": "WITH " + _GOLD + " SELECT system, count(*) AS n_parts, round(sum(CASE WHEN first_rank <= 50 THEN 1.0::DOUBLE / first_rank ELSE 0 END) / count(*), 9) AS part_mrr FROM fr GROUP BY system",
    "first_hit_histogram": "WITH " + _GOLD + " SELECT system, CASE WHEN first_rank IS NULL THEN 'none' WHEN first_rank = 1 THEN '1' WHEN first_rank <= 3 THEN '2-3' WHEN first_rank <= 10 THEN '4-10' WHEN first_rank <= 50 THEN '11-50' ELSE 'beyond' END AS bucket, count(*) AS n FROM fr GROUP BY ALL",
    "miss_diagnostics": "WITH " + _MISS + " SELECT system, q_id, item_id, k, parts, hits, coalesce(first_below, -1)::BIGINT AS first_below, labels FROM ml",
    "failure_counts": "WITH " + _MISS + " SELECT system, k, label, count(*) AS n FROM (SELECT system, k, unnest(string_split(labels, ';')) AS label FROM ml) GROUP BY ALL",
    "system_comparison": "WITH " + _GOLD + ", pn AS (SELECT system, k, " + _PANEL + " FROM it2 GROUP BY system, k), lg AS (SELECT system, k, 'part_recall' AS metric, part_recall AS v FROM pn UNION ALL SELECT system, k, 'item_coverage', item_coverage FROM pn UNION ALL SELECT system, k, 'weighted_strict', weighted_strict FROM pn) SELECT a.k, a.metric, a.v AS value_a, b.v AS value_b, round(abs(a.v - b.v), 9) AS difference FROM lg a JOIN lg b ON a.k = b.k AND a.metric = b.metric AND a.system = 'cosine' AND b.system = 'dot'",
    "paragraphs_with_offsets": "WITH " + _PARAGRAPHS + " SELECT doc_id, position, char_start, char_start + length(text) AS char_end, n_tokens, sha256(text) AS text_sha256 FROM pa",
    "section_forward_fill": "WITH " + _PARAGRAPHS + " SELECT doc_id, position, length(text) <= 40 AS is_heading, last_value(CASE WHEN length(text) <= 40 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM pa",
    "prev_next_links": "SELECT conv_id, turn, c AS chunk_id, lag(c) OVER w AS prev_chunk_id, lead(c) OVER w AS next_chunk_id FROM (SELECT conv_id, turn, concat(conv_id::VARCHAR, '/', turn::VARCHAR) AS c FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "token_counts": r"SELECT conv_id, turn, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM conversations",
    "chunk_ids": "WITH " + _PARAGRAPHS + " SELECT doc_id, position, sha256(concat(doc_id::VARCHAR, ':', position::VARCHAR, ':', char_start::VARCHAR, ':', (char_start + length(text))::VARCHAR, ':'))[1:16] AS chunk_id FROM pa",
    "greedy_chunks": "WITH RECURSIVE " + _PARAGRAPHS + """, g AS (SELECT doc_id, position, 0::BIGINT AS chunk, n_tokens AS held, n_tokens FROM pa WHERE position = 0
 UNION ALL SELECT p.doc_id, p.position, CASE WHEN g.held + p.n_tokens > 800 AND g.held >= 400 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN g.held + p.n_tokens > 800 AND g.held >= 400 THEN p.n_tokens ELSE g.held + p.n_tokens END, p.n_tokens
 FROM g JOIN pa p ON p.doc_id = g.doc_id AND p.position = g.position + 1)
SELECT doc_id, chunk, min(position) AS first_position, max(position) AS last_position, count(*) AS n_blocks, sum(n_tokens)::BIGINT AS n_tokens FROM g GROUP BY doc_id, chunk""",
    "row_group_split": "SELECT l_suppkey, (i // 40 * 40)::BIGINT AS suffix, count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i FROM lineitem) GROUP BY ALL",
    "page_title": r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \t\n\r]+', ' ', 'g')) AS title, len(regexp_extract_all(html, '<a [^>]*href='))::BIGINT AS n_links FROM pages",
    "unit_scale_detect": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 9 ELSE 0 END::INT AS scale FROM customer",
    "formula_eval": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) / -l_quantity AS result FROM lineitem",
    "passage_provenance": "SELECT DISTINCT b.item_id, d.doc_id, strpos(d.text, b.text) - 1 AS char_start FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''",
    "corpus_fingerprint": "WITH h AS (SELECT sha256(text) AS h FROM documents), g AS (SELECT ('0x' || h[1:3])::INT AS g, sha256(string_agg(h, ',' ORDER BY h)) AS gh FROM h GROUP BY h[1:3]) SELECT sha256('0.1.1:' || string_agg(gh, ',' ORDER BY g)) AS fingerprint FROM g",
    "min_hitting_set": """WITH g AS (SELECT l_suppkey, l_returnflag AS part, bit_or(1 << (6 - l_partkey % 7)::INT) AS m FROM lineitem GROUP BY ALL),
c AS (SELECT s.l_suppkey, r.x::INT AS mask FROM (SELECT DISTINCT l_suppkey FROM g) s, range(1, 128) r(x) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.l_suppkey = s.l_suppkey AND (g.m & r.x::INT) = 0)),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY bit_count(mask), mask DESC) AS n FROM c)
SELECT l_suppkey, (SELECT count(*) FROM g WHERE g.l_suppkey = b.l_suppkey) AS n_parts, array_to_string(list_filter([0, 1, 2, 3, 4, 5, 6], lambda a: ((mask >> (6 - a)) & 1) = 1), ',') AS chosen FROM b WHERE n = 1""",
    "lexical_tokens": "WITH " + TOKENS + " SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(t, ' ')) AS fingerprint FROM toks",
    "percent_cells": """WITH c AS (SELECT l_linenumber % 3 AS m, CASE l_linenumber % 3 WHEN 0 THEN -(printf('%.1f', l_discount * 100)::DOUBLE) WHEN 1 THEN printf('%.1f', l_discount * 100)::DOUBLE ELSE 1000 + printf('%.0f', l_quantity)::DOUBLE END AS v FROM lineitem)
SELECT m = 0 AS is_percent, m = 0 AS is_negative, m = 2 AS has_comma, CASE WHEN m = 1 THEN 'pp' END AS change_unit, count(*) AS n, round(sum(v), 3) AS total FROM c GROUP BY ALL""",
    "outline_paths": """WITH t AS (SELECT o_custkey, o_orderkey AS position, CASE WHEN o_orderkey % 7 = 0 THEN 'PART ' || (['I', 'II', 'III'])[o_orderkey % 3 + 1] END AS p, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0 THEN 'Item ' || (o_orderkey % 9)::VARCHAR || '.' END AS i FROM orders),
f AS (SELECT *, last_value(p IGNORE NULLS) OVER w AS part, last_value(CASE WHEN p IS NOT NULL THEN position END IGNORE NULLS) OVER w AS pp, last_value(i IGNORE NULLS) OVER w AS li, last_value(CASE WHEN i IS NOT NULL THEN position END IGNORE NULLS) OVER w AS ip FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT o_custkey, position, part, CASE WHEN pp IS NULL OR ip > pp THEN li END AS item, concat_ws(' > ', part, CASE WHEN pp IS NULL OR ip > pp THEN li END) AS path FROM f""",
}
