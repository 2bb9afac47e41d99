"""Operators 1, 5, 6, 8 against plain versions."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import cross_entropy, merkle, toxicity, warc

# --- 1


class Plain(HTMLParser):
    """Text without scripts, styles and titles' place kept, as words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.skip, self.links = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        if tag == "body":
            self.skip = 0
        self.links += tag == "a" and dict(attrs).get("href") is not None
        if tag in warc.BLOCK:
            self.words.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head") and self.skip:
            self.skip -= 1
        if tag in warc.BLOCK:
            self.words.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_derivatives(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = warc.op1(spark, pages).collect()
    html = {r.page_id: (r.url, r.html) for r in pages.collect()}
    assert Counter((r.page_id, r.warc_type) for r in got) == Counter((p, k) for p in html for k in ("metadata", "conversion"))
    response = {r.page_id: r.record_id for r in warc.responses(pages).collect()}
    assert len({r.record_id for r in got} | set(response.values())) == 3 * len(html)
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    by = {(r.page_id, r.warc_type): r for r in got}
    for r in got:
        url, page = html[r.page_id]
        block = r.block.encode()
        assert r.refers_to == response[r.page_id] and r.target_uri == url and r.content_length == len(block) and r.block_digest == sha(block)
        assert r.source_payload_digest == sha(page.encode()) and r.source_block_digest == sha(r.source_headers.encode() + b"\r\n\r\n" + page.encode())
        assert f"Content-Length: {len(page.encode())}" in r.source_headers
        assert r.linked_to == by[(r.page_id, "conversion" if r.warc_type == "metadata" else "metadata")].record_id
        plain = Plain()
        plain.feed(page)
        if r.warc_type == "conversion":
            assert r.block.split() == "".join(plain.words).split()
        else:
            assert r.block.count("outlink: ") >= plain.links
    assert [tuple(r) for r in warc.op1(spark, pages.repartition(3)).orderBy("record_id").collect()] == sorted(map(tuple, got), key=lambda t: t[2])


def test_derivatives_of_odd_pages(spark):
    import time

    long = "<p>word <a href=/x>y</a>" * 40_000
    pages = [(None, None, None), (1, None, "<p>a"), (2, "http://a/b", None), (2, "http://a/b", None), (3, "http://a/b", ""), (4, "http://a/b", "<a " + "x" * 1_000_000), (5, "http://a/b", "<a " + "x " * 300_000 + "=1>"), (6, "http://a/b", long), (6, "http://a/b", long)]
    began = time.time()
    got = warc.op1(spark, spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))).collect()
    assert time.time() - began < 60
    assert Counter((r.page_id, r.warc_type) for r in got) == Counter((p, k) for p, _, _ in pages for k in ("metadata", "conversion"))
    text = {r.page_id: r.block.split() for r in got if r.warc_type == "conversion"}
    assert text[1] == ["a"] and text[None] == text[2] == text[3] == [] and text[6] == ["word", "y"] * 40_000
    twice = [r for r in got if r.page_id == 6]
    assert len({r.record_id for r in twice}) == 2 and len({r.block for r in twice}) == 2  # rows alike are one record written twice


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<html lang=xx><title>T &amp; t</title><body><p>x<br>y<a href='/d'>é</a>"), (None, None, None), (2, "u", ""), (2, "u", ""), (3, "http://[", "<a href='http://[x'>q <!-- never closed"), (4, "v", "WARC/1.1\r\n\r\n a < b <i title='1>2'>k</i>" + "<p>long" * 20000)], "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    records = warc.derive(warc.responses(pages))
    for how in ("gzip", "none"):
        path = str(tmp_path / how)
        warc.write(records, path, how)
        back = warc.read(spark, path).collect()
        want = Counter((r.warc_type, r.record_id, r.refers_to, r.block_digest, bytes(r.block)) for r in records.collect())
        assert Counter((r.headers["WARC-Type"], r.headers["WARC-Record-ID"], r.headers["WARC-Refers-To"], r.headers["WARC-Block-Digest"], bytes(r.block)) for r in back) == want
    text = {r.page_id: r.block for r in warc.op1(spark, pages).filter("warc_type = 'conversion'").collect()}
    assert text[1] == "T & t\nx\nyé" and text[None] == "" and text[3] == "q" and text[4].startswith("WARC/1.1 a < b k\nlong")
    meta = {r.page_id: r.block for r in warc.op1(spark, pages).filter("warc_type = 'metadata'").collect()}
    assert "title: T & t\r\nlanguage: xx\r\nhttp-status: 200" in meta[1] and "outlink: http://a.b/d a\r\n" in meta[1]
    assert warc.op1(spark, pages.limit(0)).count() == 0


def test_warc_records_of_others(spark, tmp_path):
    """Any file name, lower-case headers, one gzip member for each record, records cut off."""
    import gzip

    record = lambda block, extra=b"": b"WARC/1.0\r\nwarc-type: response\r\ncontent-length: " + str(len(block)).encode() + b"\r\n" + extra + b"\r\n" + block + b"\r\n\r\n"
    (tmp_path / "crawl.warc.gz").write_bytes(gzip.compress(record(b"one")) + gzip.compress(record(b"two WARC/1.0\r\n\r\n")))
    (tmp_path / "cut.warc").write_bytes(record(b"three") + record(b"x" * 500)[:200])
    (tmp_path / "cut.gz").write_bytes(gzip.compress(record(b"four") + record(bytes(range(256)) * 40))[:-30])
    (tmp_path / "headless.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: metadata\r\n\r\nno length\r\n\r\n" + record(b"five") + b"WARC/1.0\r\nwarc-ty")
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.block) for r in got if r.whole) == sorted([b"one", b"two WARC/1.0\r\n\r\n", b"three", b"four", b"five"])
    torn = [bytes(r.block) for r in got if not r.whole]
    assert b"no length" in torn and b"" in torn and any(b and set(b) == {120} for b in torn)


def test_heads_without_an_end():
    assert warc.parse("<html><head><title>T</title><meta x><p>kept</p>all", "")["text"] == "kept\nall"
    assert warc.parse("<head><link href=a><script>no</script></head>b", "")["text"] == "b"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<a href='x'>", "<a \"", "text", "<", ">", "<!--", "-->", "<script>", "</script>", "&lt;", "&", "'", '"', "<br/>", " ", "\n"]), max_size=30).map("".join))
def test_any_page_parses(page):
    warc.parse(page, "http://a/b")


# --- 8


def plain_next(docs):
    """docs in descending order; (row, next row)."""
    return [(docs[i], docs[(i + 1) % len(docs)]) for i in range(len(docs))]


def plain_tree(text):
    """Root, and leaves by section and paragraph: cut character by character, hashed from the leaves up."""
    lines = (text or "").split("\n")
    tree, blank = [], True
    for i, line in enumerate(lines):
        if not tree or blank and line.strip() or line[:1] == "#":
            tree.append([])
        blank = not line.strip()
        rest, leaves = line + "\n" * (i < len(lines) - 1), []
        while rest:
            n = 0
            while n < len(rest) and rest[n] not in ".!?":
                n += 1
            while n < len(rest) and rest[n] in ".!?":
                n += 1
            while n < len(rest) and rest[n].isspace():
                n += 1
            # The text's own end has no line end; the operator cuts with it and takes it off again.
            piece, rest = rest[:n], rest[n:]
            if len(piece) + (not rest and i == len(lines) - 1) <= 120:
                leaves.append(piece)
                continue
            word = part = ""
            for k, c in enumerate(piece):
                part, word = part + c, word + c
                last = k + 1 == len(piece)
                if (c.isspace() and (last or not piece[k + 1].isspace())) or last:
                    whole = word + "\n" * (last and not rest and i == len(lines) - 1)
                    if zlib.crc32(whole.encode()) % 8 == 0:
                        leaves.append(part)
                        part = ""
                    word = ""
            if part:
                leaves.append(part)
        tree[-1].append(leaves)
    h = lambda tag, parts: hashlib.sha256(tag + b"".join(parts)).digest()
    root = h(b"\3", [h(b"\2", [h(b"\1", [h(b"\0", [x.encode()]) for x in p]) for p in s]) for s in tree])
    return root.hex()[:32], [[[h(b"\0", [x.encode()]).hex()[:8] for x in p] for p in s] for s in tree]


def plain_likeness(a, b):
    (r, x), (q, y) = a, b
    if r == q:
        return 1.0
    x, y = (Counter(leaf for s in t for p in s for leaf in p) for t in (x, y))
    n = x.total() + y.total()
    return min(2 * (x & y).total() / n, 1 - 1 / (n + 1)) if n else 0.0


COLS8 = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"]


def check_merkle(spark, df, rows):
    """rows: (doc_id, text) in the operator's order."""
    want, trees = Counter(), Counter()
    for (d, t), (_, u) in plain_next(rows):
        k = len(t) // 3
        e = t[: len(t) - k] + u[:k]
        f, g, h = map(plain_tree, (t, e, u))
        want[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(plain_likeness(f, g), 9), round(plain_likeness(f, h), 9))] += 1
        trees[(d, str(f), str(g))] += 1
    got = merkle.op8(spark, df).collect()

    def tree(fp):
        return fp[:32], [[[p[i : i + 8] for i in range(8, len(p), 8)] for p in s[9:].split(";")] for s in fp[33:].split("|")]

    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert Counter((r.doc_id, str(tree(r.fingerprint)), str(tree(r.edited_fingerprint))) for r in got) == trees
    for r in got:
        assert (r.n_gone + r.n_new + r.n_moved > 0) == (r.fingerprint[:32] != r.edited_fingerprint[:32])
    return got


def test_merkle(spark, tiny, none):
    docs = sorted(((r.doc_id, r.text) for r in tiny.collect()), reverse=True)
    for df in (tiny, tiny.repartition(7)):
        got = check_merkle(spark, df, docs)
    assert merkle.op8(spark, none).count() == 0
    one = merkle.op8(spark, tiny.filter(F.col("doc_id") == docs[0][0])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    mean = lambda k: sum(r[k] for r in got) / len(got)
    assert 0.5 < mean("near_edited") < 0.8 and mean("near_next") < 0.2


def test_merkle_of_odd_rows(spark, odd):
    rows = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    check_merkle(spark, odd, [(r.doc_id, r.t) for r in rows])
    same = odd.withColumn("doc_id", F.lit(7).cast("long"))
    rows = sorted(rows, key=lambda r: r.h)
    check_merkle(spark, same, [(7, r.t) for r in rows])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n#!é\x1c", max_size=400), st.text(alphabet="ab. \n#!é", max_size=30))
def test_cuts_partition_the_text(text, other):
    assert "".join(x for s in merkle.cut(text) for p in s for x in p) == text
    f, g = merkle.fingerprint(text), merkle.fingerprint(other)
    assert (f == g) == (text == other) == (merkle.likeness(f, g) == 1.0) == (not any(merkle.differences(f, g)))
    assert merkle.likeness(f, g) == merkle.likeness(g, f) and 0 <= merkle.likeness(f, g) <= 1


def test_differences_locate_edits():
    text = "# A\nFirst line. Second.\nThird.\n\nNew section here.\nIts last line.\n"
    edits = lambda other: tuple(merkle.differences(merkle.fingerprint(text), merkle.fingerprint(other)))
    assert edits(text.replace("Third", "3rd")) == ([(0, 2)], [(0, 2)], [])
    assert edits(text.replace("line.\n", "line. More.\n")) == ([(1, 1)], [(1, 1)], [])
    assert edits("# New\nBefore all.\n\n" + text) == ([], [(0, 0), (0, 1), (0, 2)], [])
    assert edits(text.replace("New section here.\n", "")) == ([(1, 0)], [], [])
    assert edits(text.replace("Third.\n", "Third.\nFourth.\nFifth.\n")) == ([], [(0, 3), (0, 4)], [])
    swapped = "# A\none\n# B\ntwo\n# C\nthree"
    moved = merkle.differences(merkle.fingerprint(swapped), merkle.fingerprint("# B\ntwo\n# A\none\n# C\nthree"))
    assert moved.gone == moved.new == [] and moved.moved in ([((0, None), (1, None))], [((1, None), (0, None))])


# --- 6


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    chain = toxicity.train_chain(docs, labels.filter(~held))
    got = toxicity.score(docs, chain).join(labels.filter(held).withColumnRenamed("toxic", "is"), "doc_id").collect()
    hit = sum(r.toxic and r["is"] for r in got)
    assert hit >= 0.9 * sum(r["is"] for r in got) and hit >= 0.9 * sum(r.toxic for r in got)
    again = toxicity.train_chain(docs.repartition(5), labels.filter(~held).repartition(3))
    assert again.columns == chain.columns and all(np.allclose(a, b) for a, b in zip(again.weights, chain.weights))
    kept = toxicity.clean(docs, chain)
    assert kept.schema == docs.schema
    bad = {r.doc_id for r in toxicity.score(docs, chain).filter("toxic").collect()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id not in bad)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 3 % 2, i % 2) for i in range(50)] + [(None, 1, 1), (3, None, 1), (4, 1, None), (7, 0, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.op6(spark, odd, labels).count() == odd.count()
    assert toxicity.op6(spark, none, labels).count() == 0
    for few in (labels.limit(0), labels.filter("toxic = 0 and quality = 1")):
        assert toxicity.op6(spark, odd, few).filter("toxic").count() == 0
    assert toxicity.clean(odd, toxicity.train_chain(odd, labels.limit(0))).count() == odd.count()


def test_repeated_ids_are_fitted_once(spark, tiny):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    ids = [r.doc_id for r in labels.select("doc_id").distinct().limit(10).collect()]
    again = tiny.filter(F.col("doc_id").isin(ids)).withColumn("text", F.concat("text", F.lit(" more")))
    chain = toxicity.train_chain(tiny.unionByName(again).unionByName(again), labels)
    assert not chain.held_out or chain.held_out["rows"] <= labels.select("doc_id").distinct().count()


def plain_logistic(x, y, l2=1.0):
    """Newton's method on a dense design with a free constant last."""
    w = np.zeros(x.shape[1])
    penal = np.r_[np.full(x.shape[1] - 1, l2), 0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penal) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penal * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def test_chain_against_a_plain_one():
    """Out-of-fold fits, log-odds fed forward and scores, each on dense matrices by another method."""
    rng = np.random.default_rng(4)
    n, width, folds = 300, 6, 3
    index = [np.unique(rng.integers(0, width, rng.integers(0, 5))) for _ in range(n)]
    dense = rng.normal(size=(n, toxicity.DENSE))
    sparse = np.zeros((n, width))
    for i, f in enumerate(index):
        sparse[i, f] = 1
    low = (rng.random(n) < 1 / (1 + np.exp(-(sparse[:, 0] * 2 - 1 + dense[:, 0])))).astype(int)
    toxic = (rng.random(n) < 1 / (1 + np.exp(-(sparse[:, 1] * 2 + low - 2)))).astype(int)
    y, fold = np.c_[low, toxic, low * toxic], np.arange(n) % folds
    chain = toxicity.train(index, dense, y, fold, {k: k for k in range(width)}, folds)
    odds = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    z = np.clip((dense - dense.mean(0)) / np.maximum(dense.std(0), 1e-6), -5, 5)
    fit_x = score_x = np.c_[z, np.ones(n)]
    want = []
    for c in range(3):
        x, own = np.c_[sparse, fit_x], np.zeros(n)
        for f in range(folds):
            w = plain_logistic(x[fold != f], y[fold != f, c])
            own[fold == f] = 1 / (1 + np.exp(-x[fold == f] @ w))
        p = 1 / (1 + np.exp(-np.c_[sparse, score_x] @ plain_logistic(x, y[:, c])))
        want.append(p)
        fit_x, score_x = np.c_[odds(own), fit_x], np.c_[odds(p), score_x]
    got = chain.predict(index, dense)
    assert np.abs(got - np.array(want).T).max() < 0.02


def test_fit_is_at_the_minimum():
    rng = np.random.default_rng(0)
    index = [np.unique(rng.integers(0, 5, rng.integers(0, 4))) for _ in range(200)]
    dense = np.c_[rng.normal(size=(200, 2)), np.ones(200)]
    y = (rng.random(200) < 0.4).astype(float)
    x = toxicity.Rows(index, dense, 5)
    w = toxicity.fit(x, y, steps=200)
    full = np.zeros((200, 8))
    for i, f in enumerate(index):
        full[i, f] = 1
    full[:, 5:] = dense
    penal = np.r_[np.ones(7), 0]
    gradient = full.T @ (toxicity.sigmoid(full @ w) - y) + penal * w
    assert np.abs(gradient).max() < 0.05 and np.allclose(x.times(w), full @ w)


def test_chain_feeds_earlier_probabilities():
    """The second category is the first one's twin but for rows without any feature: only the chain tells them."""
    rng = np.random.default_rng(1)
    index = [np.array([0]) if i % 2 else np.zeros(0, np.int64) for i in range(400)]
    y = np.array([[i % 2] * 3 for i in range(400)])
    chain = toxicity.train(index, rng.normal(size=(400, toxicity.DENSE)), y, np.arange(400) % 4, {1: 0}, 4)
    assert [len(w) - len(chain.weights[0]) for w in chain.weights] == [0, 1, 2]
    assert chain.weights[1][len(chain.columns)] > 0.1 and chain.held_out["f1"] > 0.99


# --- 5


def plain_scores(docs, target, tokenizer, mu=64.0, alpha=0.5):
    size = tokenizer.get_vocab_size()
    ids = [[size, *tokenizer.encode(t or "", add_special_tokens=False).ids] for _, t in docs]
    counts = []
    for keep in (lambda d: d in target, lambda d: True):
        big, uni, his = Counter(), Counter(), Counter()
        for (d, _), x in zip(docs, ids):
            if keep(d):
                big.update(zip(x, x[1:]))
                uni.update(x[1:])
                his.update(x[:-1])
        counts.append((big, uni, his, sum(uni.values())))
    out = []
    for (d, _), x in zip(docs, ids):
        n = len(x) - 1
        mean = [sum(-math.log((b[(h, w)] + mu * (u[w] + alpha) / (total + alpha * size)) / (hh[h] + mu)) for h, w in zip(x, x[1:])) / n if n else None for b, u, hh, total in counts]
        out.append((d, n, *mean, mean[0] - mean[1] if n else None))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x if x is None or isinstance(x, int) else round(x, 7)) for x in r)
    text = lambda rows: sorted(str(key(r)) for r in rows)
    assert text(got) == text(want)


@pytest.mark.parametrize("chunk, sent", [(2_000_000, 8_000_000), (3000, 8_000_000), (3000, -1)])
def test_cross_entropy(spark, tiny, odd, none, chunk, sent, monkeypatch):
    monkeypatch.setattr(cross_entropy, "BROADCAST_IDS", sent)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1 and toxic = 0")
    got = cross_entropy.scores(tiny, labels, chunk_tokens=chunk).collect()
    docs = [(r.doc_id, r.text) for r in tiny.collect()]
    same(map(tuple, got), plain_scores(docs, {r.doc_id for r in labels.collect()}, tokenizer))
    ids = spark.createDataFrame([(3,), (3,), (8,), (None,), (999,)], "doc_id long")
    same(map(tuple, cross_entropy.scores(odd, ids, chunk_tokens=chunk).collect()), plain_scores([(r.doc_id, r.text) for r in odd.collect()], {3, 8}, tokenizer))
    assert cross_entropy.scores(none, ids).count() == 0
    assert cross_entropy.scores(odd, ids.limit(0)).count() == odd.count()
