"""Exact cosine and dot-product search: vectors lie in blocks, rows of a matrix each; a task multiplies its blocks with all queries and hands on its k best for each query."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.written import discard, shared_folder
from .lexical import rank

#: Queries sent to the tasks at once (4 MB of doubles at 32 dimensions, 128 at 1024); more take further passes over the blocks.
QUERY_BLOCK = 16_384
#: Vectors in a block, and scores that a task holds at once.
ROWS, SCORES = 4096, 1 << 22


def norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def checked_norms(vectors: DataFrame, key: str = "vec_id", v: str = "embedding") -> DataFrame:
    """(key, dim, norm, valid): vectors with a zero or non-finite norm aren't valid."""
    n = norm(v)
    return vectors.select(key, F.size(v).cast("long").alias("dim"), F.round(n, 6).alias("norm"), ((n > 0) & ~F.isnan(n) & (n < float("inf"))).alias("valid"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles, and which rows are vectors; null and empty ones aren't (rows of nan), null values are nan. All others have one dimension."""
    sizes = np.array(column.value_lengths().fill_null(0))
    dims = np.unique(sizes[sizes > 0])
    if len(dims) > 1:
        raise ValueError(f"vectors of several dimensions: {dims.tolist()}")
    out = np.full((len(sizes), dims[0] if len(dims) else 0), np.nan)
    out[sizes > 0] = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, out.shape[1]) if len(dims) else 0
    return out, sizes > 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, vector, kept columns as a struct) to (keys, kept, n, dim, n_vectors, matrix), ROWS to a block."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            s = b.slice(lo, ROWS)
            m, is_vector = _matrix(s.column(1))
            as_list = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            cols = [as_list(s.column(0)), as_list(s.column(2)), pa.array([len(m)], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([int(is_vector.sum())], pa.int32()), pa.array([m.astype("<f8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["keys", "kept", "n", "dim", "n_vectors", "matrix"])


def in_blocks(vectors: DataFrame, key: str, v: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each block, made where the vectors are read: nothing is shuffled."""
    rows = vectors.select(F.col(key).alias("key"), F.col(v).alias("v"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("kept"))
    t = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(_blocks, f"keys array<{t['key']}>, kept array<{t['kept']}>, n int, dim int, n_vectors int, matrix binary")


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


class Best:
    """The k best of each query so far, by (-score, key)."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.held, self.rows = k, np.full(n, -np.inf), [], 0

    def offer(self, keys: np.ndarray, scores: np.ndarray, admitted: np.ndarray) -> None:
        """scores: (keys, queries)."""
        i, q = np.nonzero((scores >= self.floor) & admitted[:, None])
        self.held.append((q, keys[i], scores[i, q]))
        self.rows += len(q)
        if self.rows > SCORES:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.held:
            return None
        q, key, score = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((key, -score, q))
        q, key, score = q[order], key[order], score[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = place < self.k
        last = place == self.k - 1
        self.floor[q[last]] = score[last]
        self.held, self.rows = [(q[keep], key[keep], score[keep])], int(keep.sum())
        return self.held[0]


def _searched(batches: Iterator[pa.RecordBatch], handle, k: int, cosine: bool) -> Iterator[pa.RecordBatch]:
    """Rows (keys, n, dim, matrix, admitted) to (query, key, score), k rows at most for each query."""
    qkeys, wanted = handle.value
    norms = np.sqrt((wanted * wanted).sum(1))
    best, kind = Best(len(wanted), k), None
    for b in batches:
        for row in range(b.num_rows):
            keys, n, dim = b.column(0)[row].values, b.column(1)[row].as_py(), b.column(2)[row].as_py()
            kind, plain = keys.type, keys.to_numpy(zero_copy_only=False)
            plain = plain.astype(str) if plain.dtype == object else plain
            if not dim or not len(wanted):
                continue
            if dim != wanted.shape[1]:
                raise ValueError(f"vectors have {dim} dimensions, queries {wanted.shape[1]}")
            m = np.frombuffer(b.column(3)[row].as_buffer(), "<f8").reshape(n, dim)
            with np.errstate(all="ignore"):
                own = np.sqrt((m * m).sum(1))
            ok = (own > 0) & np.isfinite(own) if cosine else np.isfinite(m).all(1)
            if b.column(4)[row].is_valid:
                ok &= np.array([bool(x) for x in b.column(4)[row].as_py()])
            step = max(1, SCORES // len(wanted))
            for lo in range(0, n, step):
                at = slice(lo, lo + step)
                with np.errstate(all="ignore"):
                    s = m[at] @ wanted.T
                    s = _rounded(s / (own[at, None] * norms) if cosine else s)
                best.offer(plain[at], s, ok[at])
    got = best.settle()
    if got is not None:
        yield pa.RecordBatch.from_arrays([qkeys.take(pa.array(got[0])), pa.array(got[1].tolist(), kind), pa.array(got[2])], names=["query", "key", "score"])


def search_blocks(blocks: DataFrame, queries: DataFrame, k: int, admitted: Column | None, cosine: bool, key: str, qkey: str, qv: str) -> DataFrame:
    """(qkey, key, score, rank) over a table of blocks; admitted: an array of booleans, one for each row of a block."""
    spark, n = blocks.sparkSession, queries.count()
    passes, out = max(1, -(-n // QUERY_BLOCK)), None
    t, kinds = blocks.select("keys", "n", "dim", "matrix", (F.lit(None).cast("array<boolean>") if admitted is None else admitted).alias("admitted")), dict(blocks.dtypes)
    schema = f"query {dict(queries.dtypes)[qkey]}, key {kinds['keys'].removeprefix('array<')[:-1]}, score double"
    for p in range(passes):
        asked = queries.select(qkey, qv) if passes == 1 else queries.select(qkey, qv).filter(F.pmod(F.xxhash64(qkey), F.lit(passes)) == p)
        table = asked.toArrow().combine_chunks()
        vectors = table.column(1).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
        m, _ = _matrix(vectors)
        with np.errstate(all="ignore"):
            length = np.sqrt((m * m).sum(1))
        ok = np.isfinite(length) & (length > 0) if cosine else np.isfinite(length)
        handle = spark.sparkContext.broadcast((table.column(0).combine_chunks().filter(pa.array(ok)) if len(ok) else pa.array([], table.schema.field(0).type), m[ok]))
        scored = t.mapInArrow(lambda it, handle=handle: _searched(it, handle, k, cosine), schema).toDF(qkey, key, "score")
        top = rank(scored, [qkey], k, key=key)
        out = top if out is None else out.unionByName(top)
    return out


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, key: str = "vec_id", v: str = "embedding", qkey: str = "q_id", qv: str = "q_embedding") -> DataFrame:
    """(q_id, key, score, rank), filters first. A vector without a direction (null, zero, or not finite) is no candidate, and as a query it has no results."""
    return search_blocks(in_blocks(vectors if where is None else vectors.filter(where), key, v), queries, k, None, True, key, qkey, qv)


def by_dot(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", v: str = "embedding", qkey: str = "q_id", qv: str = "q_embedding") -> DataFrame:
    """(q_id, key, score, rank) by the plain dot product of finite vectors."""
    return search_blocks(in_blocks(vectors, key, v), queries, k, None, False, key, qkey, qv)


class WrongIndex(ValueError):
    """An index that isn't of these vectors."""


@dataclass
class VectorIndex:
    """Written blocks, and one row about the vectors they were made of."""

    spark: SparkSession
    path: str
    key: str
    keep: tuple[str, ...] = ()

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, key: str = "vec_id", v: str = "embedding", keep: tuple[str, ...] = (), dimension: int | None = None) -> "VectorIndex":
        """keep: columns that searches may filter by. All vectors must have one dimension (`dimension`, if given); null ones are kept without being candidates."""
        spark = vectors.sparkSession
        out = cls(spark, path or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", key, tuple(keep))
        in_blocks(vectors, key, v, out.keep).write.parquet(f"{out.path}/blocks")
        dims = {r.dim for r in out.blocks().filter("n_vectors > 0").select("dim").distinct().collect()} | ({dimension} if dimension else set())
        if len(dims) > 1:
            out.drop()
            raise WrongIndex(f"vectors of several dimensions: {sorted(dims)}")
        metadata(vectors, key, v).coalesce(1).write.parquet(f"{out.path}/about")
        return out

    @classmethod
    def open(cls, path: str, vectors: DataFrame, key: str = "vec_id", v: str = "embedding", keep: tuple[str, ...] = ()) -> "VectorIndex":
        """The index under path, if it is one of exactly these vectors."""
        out = cls(vectors.sparkSession, path, key, tuple(keep))
        had, now = out.about().first().asDict(), metadata(vectors, key, v).first().asDict()
        if wrong := sorted(k for k in now if now[k] != had.get(k)):
            raise WrongIndex(f"the index under {path} is of other vectors: {', '.join(wrong)}")
        return out

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def about(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/about")

    def drop(self) -> None:
        discard(self.spark, self.path)

    def search(self, queries: DataFrame, k: int = 10, where: Callable[[Column], Column] | None = None, cosine: bool = True, qkey: str = "q_id", qv: str = "q_embedding") -> DataFrame:
        """(q_id, key, score, rank); where: of a struct with the kept columns, whether a vector is admitted."""
        return search_blocks(self.blocks(), queries, k, None if where is None else F.transform("kept", where), cosine, self.key, qkey, qv)

    def run(self, queries: DataFrame, k: int = 50, qkey: str = "q_id", qv: str = "q_embedding") -> DataFrame:
        """The batch of all queries: one row for each, how many results it has and the results in order; queries without any are there, empty."""
        got = self.search(queries, k, qkey=qkey, qv=qv)
        kind = got.schema[self.key].dataType.simpleString()
        got = got.groupBy(qkey).agg(F.array_sort(F.collect_list(F.struct("rank", "score", self.key))).alias("ranked_results"))
        out = queries.select(qkey).join(got, qkey, "left").withColumn("ranked_results", F.coalesce("ranked_results", F.array().cast(f"array<struct<rank:int,score:double,{self.key}:{kind}>>")))
        return out.withColumn("n_results", F.size("ranked_results"))


def truncation(texts: DataFrame, n_tokens: Column, most: int) -> DataFrame:
    """One row: how many texts an encoder of `most` tokens would cut, and the quantiles of their lengths, interpolated between ranks."""
    n = texts.select(n_tokens.cast("long").alias("n"))
    q = {f"p{p}": F.round(F.percentile("n", F.lit(p / 100)), 6).alias(f"p{p}") for p in (50, 90, 95, 99)}
    over = F.count(F.when(F.col("n") > most, 1))
    return n.agg(F.count("n").alias("n_texts"), over.alias("n_over"), F.round(F.try_divide(100.0 * over, F.count("n")), 6).alias("pct_over"), *q.values(), F.max("n").alias("longest"))


def metadata(vectors: DataFrame, key: str = "vec_id", v: str = "embedding") -> DataFrame:
    """One row about an index: vectors, dimensions, how many have a direction, and fingerprints of ids and values that no order of rows changes."""
    n = norm(v)
    h = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)")).cast("string")
    return vectors.agg(F.count("*").alias("n"), F.min(F.size(v)).alias("min_dim"), F.max(F.size(v)).alias("max_dim"), F.count(F.when((n > 0) & ~F.isnan(n), 1)).alias("n_directed"), h(key).alias("ids_hash"), h(key, v).alias("matrix_hash"))


def score_distribution(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.count("*").alias("n"), F.min("score").alias("min_score"), F.round(F.expr("percentile(score, 0.5)"), 6).alias("median_score"), F.max("score").alias("max_score"))
