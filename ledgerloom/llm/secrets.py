"""Operator 3: secret scans by assignment-aware lexing.

Source and configuration syntax (name = "literal", name: literal, "name": "literal", name := `literal`, name => 'literal', map["name"] = "literal",
--name=literal) is parsed into pairs of a name and literals or other names. A name whose value is another name takes that name's literals (constants
propagate, through any number of steps and concatenations), and each literal is scored by the most sensitive of the names it reaches and by what it
looks like (8 to 2048 characters without white space, mixed and even; pieces of a concatenation also as a whole). Literals that score at least `threshold` are spans of kind "literal"; spans of the three base kinds always stay.

Edge cases: a null text is empty and has no spans; null doc_ids are kept; repeated rows are separate rows; texts of any length are read whole in linear
time, names of any length count; bytes that aren't UTF-8 count as U+FFFD; a literal that several names reach has its best score, spans at one place come in
the kinds' order; constants don't pass between documents; an empty table gives no rows; other columns, whatever their names, are ignored. Positions are code points, ends exclusive; a base span is its whole match.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_text, text_batches

KINDS = ("assign", "access", "hex", "literal")
#: Fixed by the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_NEEDS = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Parts of names and how sensitive they make a name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0, "access_key": 0.9, "private_key": 1.0,
    "secret_key": 1.0, "auth": 0.6, "credential": 0.8, "credentials": 0.8, "bearer": 0.8, "signature": 0.6, "encryption_key": 0.9, "client_secret": 1.0, "connection_string": 0.7,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "example", "password", "secret", "none", "null", "true", "false", "todo", "xxxxxxxx", "your_password", "placeholder", "undefined", "redacted"}
PAIR = re.compile(
    r"""(?P<name>(?<![\w$-])(?:--)?[A-Za-z_$][\w$.-]*+|"[\w$. -]++"|'[\w$. -]++')(?P<close>\]?)[ \t]*+(?::[ \t]*+[A-Za-z_][\w.]*+[ \t]*+(?==[^=>]))?(?P<op>:=|=>|=(?!=)|:(?!:))[ \t]*+(?=\S)"""
)
TERM = re.compile(r'''(?P<q>"""|\'\'\'|"|'|`)|(?P<name>[A-Za-z_$][\w$.]*+)''')
#: What goes on after a name, and what stands without quotes, with padding.
RUNS = {"more": re.compile(r"""([^\s"'`,;+(){}\[\]<>|&=]*+)=*+"""), "bare": re.compile(r"""([^\s"'`,;(){}\[\]<>|&=]*+)=*+""")}
#: The longest literal that counts as a secret; longer ones are data.
LONGEST = 2048
JOIN = re.compile(r"[ \t]*+(?:\+|\.(?=[ \t\"'`])|\\\n)[ \t]*+")
ENDS = {'"': re.compile(r'(?:[^"\\\n]|\\.)*+"'), "'": re.compile(r"(?:[^'\\\n]|\\.)*+'"), "`": re.compile(r"(?:[^`\\]|\\.)*+`", re.S), '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*+"""', re.S), "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*+'''", re.S)}


def normal(name: str) -> str:
    """snake_case without quotes, prefixes of objects and leading dashes."""
    name = name.strip("\"'").lstrip("-").rsplit(".", 1)[-1]
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return re.sub(r"[\s.$-]+", "_", name).strip("_").lower()


def sensitivity(name: str) -> float:
    """Of a normal name: its most sensitive run of parts."""
    parts, best = name.split("_"), 0.0
    for i in range(len(parts)):
        for j in (1, 2):
            run = "_".join(parts[i : i + j])
            best = max(best, SENSITIVE.get(run, 0.0), SENSITIVE.get(run.rstrip("0123456789").rstrip("s"), 0.0))
    return best


def quality(literal: str) -> float:
    """0 to 1: how much a literal looks like a secret: length, mixture and evenness of its characters."""
    n = len(literal)
    if not 8 <= n <= LONGEST or literal.lower().strip("<>${}%*") in PLACEHOLDERS or len(set(literal)) < 4 or literal.startswith(("${", "{{", "<", "%(")) or re.search(r"\s", literal):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, 0.25 + 0.15 * kinds + 0.1 * entropy)


class Runs:
    """Ends of unquoted runs of a text. A chain (a:b:c:...) is run through once, however many names in it ask where it ends."""

    def __init__(self, text: str):
        self.text, self.seen = text, {"more": (0, 0, 0), "bare": (0, 0, 0)}

    def end(self, kind: str, at: int) -> int:
        """The end of the run at `at`, its padding included; `at` if there is none."""
        lo, hi, padded = self.seen[kind]
        if not lo <= at < hi:
            m = RUNS[kind].match(self.text, at)
            self.seen[kind] = lo, hi, padded = at, m.end(1), m.end()
        return padded if at < hi or kind == "more" else at


def pairs(text: str) -> list[tuple[str, list[tuple[int, int, bool]], dict[tuple[int, int], str]]]:
    """(normal name, literals (start, end, quoted), names referred to by their spans) of each assignment, in order."""
    out, at, runs = [], 0, Runs(text)
    while m := PAIR.search(text, at):
        literals, names, p = [], {}, m.end()
        at = m.end()
        while True:
            t = TERM.match(text, p)
            if t and t["q"]:
                e = ENDS[t["q"]].match(text, t.end())
                if not e:
                    break
                literals.append((t.end(), e.end() - len(t["q"]), True))
                p = e.end()
            else:
                e = runs.end("more", t.end()) if t else runs.end("bare", p)
                if e == p:
                    break
                if t and e == t.end():
                    names[p, e] = normal(t["name"])
                literals.append((p, e, False))
                p = e
            j = JOIN.match(text, p)
            if not j:
                break
            p = j.end()
        if literals:
            out.append((normal(m["name"]), literals, names))
            if text[m.end() : m.end() + 1] in "\"'`":
                at = max(at, p)
    return out


def joined(text: str, literals: list[tuple[int, int, bool]]) -> float:
    """The quality of quoted pieces that one assignment puts together."""
    pieces = [(a, b) for a, b, quoted in literals if quoted]
    if len(pieces) < 2 or sum(b - a for a, b in pieces) > LONGEST:
        return 0.0
    return quality("".join(text[a:b] for a, b in pieces))


def literals(text: str, threshold: float = 0.6) -> list[tuple[int, int, float]]:
    """Literal spans that reach a sensitive name with their scores; a piece of a concatenation has its own quality or the whole one's, whichever is greater."""
    if "=" not in text and ":" not in text:
        return []
    found = pairs(text)
    own: dict[str, list[tuple[int, int, float]]] = defaultdict(list)
    defined = {n for n, _, _ in found}
    into: dict[str, set[str]] = defaultdict(set)
    for name, spans, names in found:
        used = {x for x in names.values() if x in defined and x != name}
        whole = joined(text, spans)
        own[name] += [(a, b, whole if quoted and a < b else 0.0) for a, b, quoted in spans if names.get((a, b)) not in used]
        into[name] |= used
    best = {n: sensitivity(n) for n in defined}
    stack = sorted((n for n in defined if best[n]), key=lambda n: -best[n])
    while stack:
        n = stack.pop()
        for x in into[n]:
            if best[x] < best[n]:
                best[x] = best[n]
                stack.append(x)
    out = {}
    for n, spans in own.items():
        if best[n]:
            for a, b, whole in spans:
                score = best[n] * max(whole, quality(text[a:b]) if b - a <= LONGEST else 0.0)
                if score >= threshold:
                    out[(a, b)] = max(score, out.get((a, b), 0.0))
    return [(a, b, s) for (a, b), s in sorted(out.items())]


def scan(text: str, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every span, by start, then kind as listed, then end."""
    spans = []
    if ASSIGN_NEEDS.search(text):
        spans += [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    spans += [("literal", a, b, s) for a, b, s in literals(text, threshold)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for b in batches:
        spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in scan(t.as_py() or "", threshold)] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "found"])


def find(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """doc_id, found: array of (kind, start, end, score), one row for each document."""
    text_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_text().alias("text"))
    return narrow.mapInArrow(lambda it: _scan(it, threshold), "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The digest of find()."""
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "literal")
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return find(docs).select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), n("literal").alias("n_literal"),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"),
    )
