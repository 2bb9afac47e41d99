"""A store of raw files with a manifest, deterministic bundles, and a cache of vectors that is only used when all of its identity agrees."""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import canonical_json, sha256
from .html import Element, tree


class StoreError(ValueError):
    """What is stored isn't what the manifest says."""


@dataclass
class RawStore:
    """Files of one folder on the driver, immutable once the manifest names them."""

    root: str
    entries: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def load(cls, root: str) -> "RawStore":
        path = os.path.join(root, "manifest.json")
        if not os.path.exists(path):
            return cls(root)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        out = cls(root, {e["doc_id"]: e for e in said["entries"]})
        if said["fingerprint"] != out.fingerprint():
            raise StoreError("the manifest's fingerprint doesn't match its entries")
        return out

    def fingerprint(self) -> str:
        return sha256(canonical_json(sorted(e["sha256"] for e in self.entries.values())))

    def save(self) -> None:
        text = canonical_json({"entries": [self.entries[k] for k in sorted(self.entries)], "fingerprint": self.fingerprint()})
        path = os.path.join(self.root, "manifest.json")
        with open(path + ".new", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(path + ".new", path)

    def path(self, doc_id: str) -> str:
        if not re.fullmatch(r"[\w.-]+", doc_id) or doc_id.startswith("."):
            raise StoreError(f"{doc_id!r} can't name a file")
        return os.path.join(self.root, doc_id + ".htm")

    def verified(self, doc_id: str) -> bytes:
        """A named file whose hash is the manifest's."""
        if doc_id not in self.entries:
            raise StoreError(f"{doc_id} isn't in the manifest")
        if not os.path.exists(self.path(doc_id)):
            raise StoreError(f"the file of {doc_id} is missing")
        with open(self.path(doc_id), "rb") as f:
            body = f.read()
        if sha256(body) != self.entries[doc_id]["sha256"]:
            raise StoreError(f"the file of {doc_id} has changed")
        return body

    def ensure(self, doc_id: str, fetch) -> bytes:
        """The stored file, or what fetch() returns, stored."""
        if doc_id in self.entries:
            return self.verified(doc_id)
        body = fetch()
        with open(self.path(doc_id) + ".new", "wb") as f:
            f.write(body)
        os.replace(self.path(doc_id) + ".new", self.path(doc_id))
        self.entries[doc_id] = {"doc_id": doc_id, "sha256": sha256(body), "bytes": len(body)}
        self.save()
        return body


def bundle(files: dict[str, bytes]) -> bytes:
    """A tar whose bytes depend on names and contents alone."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name in sorted(files):
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(files[name]), 0o644
            t.addfile(info, io.BytesIO(files[name]))
    return out.getvalue()


def unbundled(data: bytes, expected: dict[str, str]) -> dict[str, bytes]:
    """Members by name; anything unexpected, missing, changed, or outside the bundle is an error."""
    found = {}
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t.getmembers():
            if not m.isfile() or m.name.startswith(("/", "..")) or ".." in m.name.split("/") or m.name not in expected or m.name in found:
                raise StoreError(f"unexpected member {m.name!r}")
            found[m.name] = t.extractfile(m).read()
            if sha256(found[m.name]) != expected[m.name]:
                raise StoreError(f"{m.name} has changed")
    if missing := sorted(set(expected) - set(found)):
        raise StoreError(f"missing members {missing}")
    return found


def cached_vectors(spark: SparkSession, path: str, identity: dict, compute) -> DataFrame:
    """The vectors (key, embedding) written under path for exactly this identity (model, dimension, texts' fingerprint), else compute() written there."""
    place = f"{path.rstrip('/')}/{sha256(canonical_json(identity))[:24]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df = compute()
        bad = df.filter((F.size("embedding") != identity["dimension"]) | F.exists("embedding", lambda x: F.isnan(x) | x.isNull()))
        if bad.head(1):
            raise StoreError("vectors of another dimension or with values that aren't numbers")
        df.write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def filing_document(index: str, form: str) -> str | None:
    """The address of a form's document on an index page: the first row whose fourth cell is the form, else one that contains it; a viewer's prefix goes."""
    rows = [r.children("td") for t in tree(index).all("table") if "tableFile" in t.attrs.get("class", "").split() for r in t.all("tr")]
    rows = [r for r in rows if len(r) >= 4]
    want = form.lower()

    def link(r: list[Element]) -> str | None:
        found = [a.attrs["href"] for c in r for a in c.all("a") if a.attrs.get("href")]
        return re.sub(r"^.*/ix\?doc=", "", found[0]) if found else None

    for test in (lambda s: s == want, lambda s: want in s):
        for r in rows:
            if test(r[3].text().lower()) and (u := link(r)):
                return u
    return None
