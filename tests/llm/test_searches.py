"""Operators 3, 7, 9, 10 against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import components, cross_entropy, merkle, mixing, near_dedup, secrets, simhash, token_orc, toxicity, wu_manber
from ledgerloom.llm.encoding import WordEncoder
from tests.llm.conftest import SCHEMA

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows(df, *cols):
    return Counter(tuple(r) if cols else str(r) for r in (df.select(*cols) if cols else df).collect())


# --- 9


def plain_words(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain_contamination(docs, items):
    out = Counter()
    wins = [(i, plain_words(t)) for i, t in items]
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for item, iw in wins:
            for k in range(max(1, len(iw) - 9)) if iw else []:
                p = iw[k : k + 10]
                for at in range(len(w) - len(p) + 1):
                    if w[at : at + len(p)] == p:
                        hit.update(range(at, at + len(p)))
                        found.add(item)
        out[(doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))] += 1
    return out


COLS9 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("most", [500_000, 3])
def test_contamination_of_odd_rows(spark, odd, none, most):
    texts = [r.text for r in odd.collect() if r.text]
    long = max(texts, key=len)
    items = [(1, "the"), (2, "été ße"), (3, ""), (4, None), (5, " ".join(texts[3].split()[:14])), (6, " ".join(long.split()[100:130])), (6, "one"), (8, "alpha BETA; gamma"), (9, "no such words at all in any text here I hope")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    small = odd
    found = wu_manber.find(small, bench, max_patterns=most)
    assert sum(1 for r in found.collect() if r.spans) > 5
    if most > 3:
        assert rows(wu_manber.op9(spark, small, bench), *COLS9) == plain_contamination(docs, items)
    else:
        assert rows(found) == rows(wu_manber.find(small, bench))
    assert wu_manber.op9(spark, none, bench).count() == 0
    assert wu_manber.op9(spark, odd, bench.limit(0)).filter("contaminated").count() == 0
    kept = wu_manber.clean(small, bench, max_patterns=most)
    assert kept.schema == small.schema
    assert rows(kept, "doc_id", "text") == Counter({(d, t): n for (d, t), n in Counter(docs).items() if not any(k[5] for k in plain_contamination([(d, t)], items))})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=0, max_size=14), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), max_size=80))
def test_wu_manber(items, doc):
    search = wu_manber.searchers([(i, " ".join(x).encode()) for i, x in enumerate(items)])
    spans, found = wu_manber.hits([w.encode() for w in doc], search)
    n = sum(b - a for a, b in spans)
    assert {(0, len(doc), n, len(found), sha(",".join(sorted(map(str, found)))), n > 0): 1} == plain_contamination([(0, " ".join(doc))], [(i, " ".join(x)) for i, x in enumerate(items)])


# --- 10


def plain_tokens(docs, tokenizer):
    start, out = 0, []
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


COLS10 = ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_token_files(spark, tiny, none, odd, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = sorted((r.doc_id, r.text) for r in tiny.collect())
    path = str(tmp_path / "orc")
    got = sorted(map(tuple, token_orc.op10(spark, tiny.repartition(5), path).select(*COLS10).collect()))
    assert got == plain_tokens(docs, tokenizer)
    back = token_orc.read_tokens(spark, path, [docs[7][0]]).collect()
    assert [r.ids for r in back] == [[*tokenizer.encode(docs[7][1], add_special_tokens=False).ids, 2]]
    assert token_orc.op10(spark, none, str(tmp_path / "none")).count() == 0
    got = token_orc.op10(spark, odd, str(tmp_path / "odd")).select(*COLS10).collect()
    assert len(got) == odd.count() and sorted(r.start for r in got)[0] == 0
    assert Counter((r.n_tokens, r.ids_crc32) for r in got) == Counter((n, c) for _, _, n, c in plain_tokens([(r.doc_id, r.text) for r in odd.collect()], tokenizer))
    by = sorted(got, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(by, by[1:])) and [r.doc_id for r in by if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)


def test_files_have_stripes_indexes_and_filters(spark, tmp_path):
    """Footers say it: stripes, integers run-length encoded, row indexes and Bloom filters on doc_id; ids ascend from file to file, so statistics prune."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = token_orc.write_tokens(docs, str(tmp_path / "orc"), partitions=2, stripe_bytes=64 << 10)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    ranges, stripes = [], 0
    for file in sorted((tmp_path / "orc").glob("*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows, found = reader.rows(), reader.getStripes()
        stripes += found.size()
        for i in range(found.size()):
            footer = rows.readStripeFooter(found.get(i))
            kinds = {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
            assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds and not any(k == "BLOOM_FILTER_UTF8" and c != 1 for c, k in kinds)
            assert {x.getKind().toString() for x in list(footer.getColumnsList())[1:]} == {"DIRECT_V2"}
        assert reader.getRowIndexStride() == 1000
        own = [r.doc_id for r in spark.read.orc(str(file)).select("doc_id").collect()]
        assert own == sorted(own)
        ranges.append((own[0], own[-1]))
    assert len(ranges) == 2 and stripes >= 2 and sorted(ranges)[0][1] < sorted(ranges)[1][0]
    some = token_orc.read_tokens(spark, path, [ranges[0][0], ranges[1][1]])
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString() and some.count() == 2


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aΣσ ́ ͏ İßﬁ'sRE<|endoftext|>12́ \x1c\x85\t", max_size=40))
def test_word_encoder(text):
    enc = ENC
    text = text.encode("utf-8", "replace").decode()
    assert enc.encode([text.encode()])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


ENC = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


# --- 7


def plain_fingerprint(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    sh = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(docs, radius=4):
    fps = [plain_fingerprint(t) for _, t in docs]
    comp = list(range(len(docs)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, f"{f:016x}", least.get(root(i))) for i, ((d, _), f) in enumerate(zip(docs, fps)))


COLS7 = ["doc_id", "fingerprint", "component_id"]


def test_simhash(spark, tiny, odd, none):
    assert rows(simhash.op7(spark, tiny.repartition(3)), *COLS7) == plain_components([(r.doc_id, r.text) for r in tiny.collect()])
    assert rows(simhash.op7(spark, odd), *COLS7) == plain_components([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.op7(spark, none).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_components_of_crowded_fingerprints(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique([int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for c in centres for _ in range(60)] + rng.integers(0, 2**63, 300, dtype=np.uint64).tolist())
    fps = [int(f) for f in fps]
    df = spark.createDataFrame([(i, np.uint64(f).astype(np.int64).item()) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.first_doc: r.component_id for r in simhash.components(df, 4, block).collect()}
    comp = list(range(len(fps)))

    def root(x):
        return x if comp[x] == x else root(comp[x])

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(fps))}


@pytest.mark.parametrize("at_once, parts", [(1_000_000, 1), (1_000_000, 3), (10, 2), (4, 40)])
def test_connected(spark, at_once, parts, monkeypatch):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(-5, 3)] + [(900, 1000 + i) for i in range(300)] + [(899, 1100)]
    pairs = [pairs[i] for i in rng.permutation(len(pairs))]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(pairs, "u long, v long").repartition(parts)
    got = [(r.node, r.label) for r in components.connected(df).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {x: r for x, r in root.items() if x != r}
    assert components.connected(df.limit(0)).count() == 0
    early = [(r.node, r.label) for r in components.connected(df, settle=False).collect()]
    assert len(early) == len(dict(early)) and all(a > b and root[a] == root[b] for a, b in early)


def test_segment_plans_miss_no_pair():
    for n in (1, 10, 10**3, 10**5, 10**7, 10**9, 10**12):
        for radius in (0, 1, 3, 4, 8):
            segments = simhash.plan(n, radius)
            assert sum(w for _, w, _ in segments) == 64 and sum(max(0, r + 1) for _, _, r in segments) == radius + 1


def test_texts_that_are_no_utf8(spark, torn):
    """Bytes that aren't UTF-8 count as U+FFFD, and rows that stay keep them."""
    text = {r.doc_id: bytes(r.b).decode("utf-8", "replace") if r.b is not None else "" for r in torn.selectExpr("doc_id", "cast(text AS binary) AS b").collect()}
    assert {r.doc_id: r.spans for r in secrets.op3(spark, torn).collect()} == {d: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in secrets.scan(t)) for d, t in text.items()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(tuple(r) for r in token_orc.op10(spark, torn).select(*COLS10).collect()) == plain_tokens(sorted(text.items()), tokenizer)
    assert {r.doc_id: r.n_chars for r in merkle.op8(spark, torn).collect()} == {d: len(t) for d, t in text.items()}
    assert cross_entropy.scores(torn, torn.filter("doc_id = 1").select("doc_id")).count() == 4
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.op6(spark, torn, labels).count() == 4
    bench = spark.createDataFrame([(1, "fine words here")], "item_id long, text string")
    raw = lambda df: {r.doc_id: r.b for r in df.selectExpr("doc_id", "cast(text AS binary) AS b").collect()}
    want = raw(torn)
    assert raw(wu_manber.clean(torn, bench)) == {d: b for d, b in want.items() if d != 3}
    assert raw(toxicity.clean(torn, toxicity.train_chain(torn, labels.limit(0)))) == want
    assert raw(near_dedup.unique(torn)) == want
    assert set(raw(mixing.mixed_documents(torn))) <= set(want)
    assert simhash.op7(spark, torn).count() == 4


# --- 3


def plain_base(text):
    spans = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def check_scan(df, docs, spark):
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.op3(spark, df).collect())
    want = Counter()
    for d, t in docs:
        s = plain_base(t or "")
        k = Counter(x[0] for x in s)
        want[(d, k["assign"], k["access"], k["hex"], sha(",".join(f"{a}:{b}:{c}" for a, b, c in s)))] += 1
    assert got == want


def test_base_spans(spark, odd, none):
    small = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_scan(small, [(r.doc_id, r.text) for r in small.collect()], spark)
    check_scan(odd, [(r.doc_id, r.text) for r in odd.collect()], spark)
    assert secrets.op3(spark, none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", ":", "=", " ", "'", '"', "AKIA", "AAAA1234BBBB", "deadbeef" * 4, "abcdefgh", "x", "ſ", "é", "\n", "secret", "short"]), max_size=14).map("".join))
def test_base_spans_stay(text):
    spans = secrets.scan(text)
    assert [s[:3] for s in spans if s[0] != "literal"] == plain_base(text)
    assert all(0 <= a < b <= len(text) for _, a, b, _ in spans)


@pytest.mark.parametrize(
    "text, found",
    [
        ("db_password = 'Xk29dkQ0sLp2'", ["Xk29dkQ0sLp2"]),
        ('{"clientSecret": "s3cr3t-Value-0042", "name": "harmless-Value-0042"}', ["s3cr3t-Value-0042"]),
        ("K = 'Zx81Qpw7Lm20'\nother = K\nauth_token = other\n", ["Zx81Qpw7Lm20"]),
        ("PART = 'Zx81Qpw7'\nAPI_KEY = PART + 'Lm20Rt55'\n", ["Zx81Qpw7", "Lm20Rt55"]),
        ("access_key: Zx81Qpw7Lm20\n", ["Zx81Qpw7Lm20"]),
        ("title = 'Zx81Qpw7Lm20'", []),
        ('dbPwd="Zx8"+"1Qp"+"w7Lm20"', ["Zx8", "1Qp", "w7Lm20"]),
        ('title = "Zx8" + "1Qp" + "w7Lm20"', []),
        ("token2 = 'Zx81Qpw7Lm20'", ["Zx81Qpw7Lm20"]),
        ("url: https://example.org:443/a:b\ndbPwd: Zx81Qpw7Lm20:x=\n", ["Zx81Qpw7Lm20:x="]),
        ("password = 'changeme'", []),
        ("config['private_key'] = \"Zx81Qpw7Lm20\"", ["Zx81Qpw7Lm20"]),
        ("let pwd: string = `Zx81Qpw7Lm20`;", ["Zx81Qpw7Lm20"]),
        ("run --password=Zx81Qpw7Lm20 now", ["Zx81Qpw7Lm20"]),
        ('{"' + "very long name of a " * 40 + 'secret": "Zx81Qpw7Lm20"}', ["Zx81Qpw7Lm20"]),
    ],
)
def test_literals_by_names(text, found):
    assert [text[a:b] for a, b, _ in secrets.literals(text)] == found


def test_long_text_in_linear_time():
    import time

    for chain in ("a:", "a:b:", "a.", "a:/", "password:", 'a="', "<a xxxx ", "a:" * 1000 + "=" * 1000):
        t = time.time()
        secrets.scan(chain * (300_000 // len(chain)))
        assert time.time() - t < 20
    t = time.time()
    secrets.scan("a" * 300_000 + ": " + "x=" * 100_000 + "'" * 50_000 + "password" * 20_000)
    assert time.time() - t < 20


def test_simhash_broadcasts_no_side_that_grows(spark, odd):
    """With any threshold, the driver gathers no table of fingerprints or links for a broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 40))
    try:
        fps = simhash.fingerprints(odd, 4)
        nodes = fps.select("fp", F.col("fp").alias("comp")).distinct()
        for df in (simhash.op7(spark, odd), simhash.links(nodes, simhash.plan(60, 4), 60, 4, True, 4096), simhash.merged(nodes, fps.selectExpr("fp AS node", "doc_id AS label"))):
            df.collect()
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
