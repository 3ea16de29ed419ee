"""Embedding near-dedup by Euclidean p-stable hashing.

Equal vectors are one class.  Class vectors are normalised and hashed in several tables; a code is the
floors of random Gaussian projections over a width, and vectors of one bucket are compared by exact
cosine in double precision.  A pair is counted in the first table where it meets, so counts need no
list of pairs; a bucket sends on a count for each vector and a spanning forest of its links.  Buckets
beyond BLOCK vectors are split into blocks and every pair of blocks is a task of its own, so memory
stays bounded and no bucket is cut short.  Components of the forests give the result.

With 12 projections of width 1.5, unit vectors at cosine 0.95 share a bucket of one table with
probability 0.11, and of one of 40 tables with 0.99; at 0.98 with 0.99999.  Unrelated vectors share a
projection with probability 0.39, so buckets would fill as the input grows: the number of projections
follows the logarithm of the number of classes, by which a vector meets as many unrelated ones of a
table at every size, and the number of tables makes up for it, by which links are found as surely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import connected_components, star_labels

THRESHOLD, TABLES, PROJECTIONS, WIDTH, SEED = 0.95, 40, 12, 1.5, 20240131
#: Classes for which these numbers of tables and projections stand.
CLASSES = 10_000
#: Vectors of a bucket, or of each side of a block pair, that a task compares at once.
BLOCK = 2048


class Hasher:
    """Codes of unit vectors in every table; the same for the same seed and dimension."""

    def __init__(self, dim: int, tables: int = TABLES, k: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64([seed, dim]))
        self.a = rng.standard_normal((dim, tables * k))
        self.b = rng.random(tables * k) * width
        self.tables, self.k, self.width = tables, k, width
        self.mult = rng.integers(1, 1 << 62, k, dtype=np.int64) | 1

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) 64-bit bucket codes."""
        out = np.empty((len(unit), self.tables), np.int64)
        for at in range(0, len(unit), 1024):
            q = np.floor((unit[at : at + 1024] @ self.a + self.b) / self.width).astype(np.int64)
            with np.errstate(over="ignore"):
                out[at : at + 1024] = (q.reshape(len(q), self.tables, self.k) * self.mult).sum(axis=2)
        return out


_hashers: dict[tuple, Hasher] = {}


def hasher(dim: int, tables: int, k: int) -> Hasher:
    if (dim, tables, k) not in _hashers:
        _hashers[dim, tables, k] = Hasher(dim, tables, k)
    return _hashers[dim, tables, k]


def collision(cosine: float, width: float = WIDTH) -> float:
    """Probability that unit vectors of this cosine share one projection's cell."""
    r = width / math.sqrt(2.0 - 2.0 * cosine)
    return math.erf(r / math.sqrt(2.0)) - math.sqrt(2.0 / math.pi) / r * (1.0 - math.exp(-r * r / 2.0))


def shape(classes: int, threshold: float = THRESHOLD, tables: int = TABLES) -> tuple[int, int]:
    """(tables, projections) for a number of classes: unrelated vectors met by each, and links found, stay as they are at CLASSES."""
    more = max(0, round(math.log(max(1, classes) / CLASSES) / -math.log(collision(0.0))))
    return (math.ceil(tables * collision(threshold) ** -more) if threshold < 1 else tables), PROJECTIONS + more


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """A binary column of doubles as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), dim)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    A vector that is null, empty, zero or holds null or non-finite components links with nothing, and
    vectors of different lengths do not link.  Ids are compared as longs; rows that repeat an id are
    vectors of their own; a null id is never the smallest of its component unless all are null.  An
    empty table gives no rows; other columns are ignored.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, v).alias("v"))
    # -0.0 and 0.0 are one value.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("c", F.xxhash64("v")).withColumn("c2", F.xxhash64(F.lit(1), F.col("v")))
    classes = rows.filter("v is not null").groupBy("c", "c2").agg(F.count("*").alias("mult"), F.min("vec_id").alias("low"), F.first("v").alias("v"))
    classes = classes.select(F.monotonically_increasing_id().alias("cls"), "c", "c2", "mult", "low", F.size("v").alias("dim"), "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.asarray(x, "<f8").tobytes() for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(raw, pa.binary())], ["cls", "c", "c2", "mult", "low", "dim", "v"])

    classes = written(classes.mapInArrow(pack, "cls long, c long, c2 long, mult long, low long, dim int, v binary"), "classes")
    tables, k = shape(classes.count(), threshold, tables)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, dims = b.column("cls").to_numpy(), b.column("dim").to_numpy()
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                codes = hasher(int(d), tables, k).codes(_unit(_vectors(b.column("v").take(pa.array(mine)), int(d))))
                n = len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls[mine], tables)), pa.array(np.full(n * tables, d, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(codes.ravel())], ["cls", "dim", "t", "code"])

    coded = classes.select("cls", "dim", "v").mapInArrow(code, "cls long, dim int, t int, code long")
    full = coded.groupBy("dim", "t", "code").agg(F.count("*").alias("n")).filter("n > 1")
    met = coded.join(full, ["dim", "t", "code"])
    # A bucket of several blocks sends each vector to every pair of blocks that its own is in.
    nb = F.ceil(F.col("n") / BLOCK).cast("int")
    met = met.withColumn("nb", nb).withColumn("own", F.when(F.col("nb") > 1, F.pmod(F.xxhash64("cls", "t"), F.col("nb"))).otherwise(0).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    met = met.select("cls", "dim", "t", "code", "own", other.alias("o")).select("cls", "dim", "t", "code", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own")
    met = met.join(classes.select("cls", "mult", "v"), "cls")
    met = met.repartition("dim", "t", "code", "i", "j").sortWithinPartitions("dim", "t", "code", "i", "j", "cls")
    met = met.select("cls", "mult", "dim", "t", "code", "i", "j", "own", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            marks = _groups(b)
            held = b.slice(marks[-2]) if len(marks) > 1 else b
            yield from _compare(b, marks[:-1], threshold, tables, k)
        if held is not None and held.num_rows:
            yield from _compare(held, _groups(held), threshold, tables, k)

    links = written(met.mapInArrow(compare, "cls long, links long, root long"), "links")
    counts = links.filter("links > 0").groupBy("cls").agg(F.sum("links").alias("links"))
    parts = connected_components(links.filter("root <> cls").select(F.col("root").alias("u"), F.col("cls").alias("v")))
    known = classes.select("cls", "c", "c2", "mult", "low").join(counts, "cls", "left").join(parts.withColumnRenamed("id", "cls"), "cls", "left")
    known = known.withColumn("root", F.coalesce("root", "cls"))
    least = known.groupBy("root").agg(F.min("low").alias("component"))
    known = known.join(least, "root").select("c", "c2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component")
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("c")).alias("c"), "c2").join(known, ["c", "c2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _groups(b: pa.RecordBatch) -> np.ndarray:
    """Marks between runs of equal (dim, t, code, i, j): 0, ..., number of rows."""
    n = b.num_rows
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for c in ("dim", "t", "code", "i", "j"):
        x = b.column(c).to_numpy()
        change |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])


def _compare(b: pa.RecordBatch, marks: np.ndarray, threshold: float, tables: int, k: int) -> Iterator[pa.RecordBatch]:
    cls, mult, dim, t, i, j, own = (b.column(c).to_numpy() for c in ("cls", "mult", "dim", "t", "i", "j", "own"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo, hi in zip(marks[:-1], marks[1:], strict=True):
        if hi - lo < 2:
            continue
        left = np.flatnonzero(own[lo:hi] == i[lo])
        right = left if i[lo] == j[lo] else np.flatnonzero(own[lo:hi] == j[lo])
        if not len(left) or not len(right):
            continue
        x = _unit(_vectors(b.column("v").slice(lo, hi - lo), int(dim[lo])))
        a, c = np.nonzero(x[left] @ x[right].T >= threshold)
        a, c = left[a], right[c]
        once = a < c if i[lo] == j[lo] else a != c
        a, c = a[once], c[once]
        if not len(a):
            continue
        near = np.unique(np.concatenate([a, c]))
        codes = hasher(int(dim[lo]), tables, k).codes(x[near])[:, : t[lo]]
        a, c = np.searchsorted(near, a), np.searchsorted(near, c)
        new = np.ones(len(a), dtype=bool)
        for at in range(0, len(a), 65536):
            new[at : at + 65536] = ~(codes[a[at : at + 65536]] == codes[c[at : at + 65536]]).any(axis=1)
        a, c = a[new], c[new]
        ids, m = cls[lo:hi][near], mult[lo:hi][near]
        n = np.bincount(a, m[c], len(near)) + np.bincount(c, m[a], len(near))
        root = star_labels(len(near), a, c)
        some = n > 0
        out.append((ids[some], n[some].astype(np.int64), ids[root][some]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["cls", "links", "root"])


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95
), reach as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a),
n as (select a, count(*) as n from l group by a), c as (select a, min(b) as m from reach group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, least(vec_id, coalesce(c.m, vec_id)) as component_id,
  vec_id <= coalesce(c.m, vec_id) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
"""
