"""Linear algebra: coordinate matrices (i, j, v) as DataFrames, tall tables by Gram sums, small factors in numpy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.elementwise import num


def to_coordinates(df: DataFrame, row: str, variables: Sequence[str]) -> DataFrame:
    """A wide table as (i, j, v), nonzeros only."""
    cells = F.array(*[F.struct(F.lit(k + 1).alias("j"), num(c).alias("v")) for k, c in enumerate(variables)])
    return df.select(F.col(row).cast("long").alias("i"), F.inline(cells)).filter("v <> 0")


def from_numpy(spark: SparkSession, a: np.ndarray) -> DataFrame:
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(p) + 1, int(q) + 1, float(a[p, q])) for p, q in zip(i, j, strict=True)], "i long, j long, v double")


def to_numpy(m: DataFrame, rows: int, cols: int) -> np.ndarray:
    """A small matrix on the driver; its size is the caller's."""
    a = np.zeros((rows, cols))
    for r in m.collect():
        a[r.i - 1, r.j - 1] = r.v
    return a


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def mtimes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One equi-join on the inner index and one aggregate; page columns in both take part in the join."""
    pages = [c for c in a.columns if c not in "ijv" and c in b.columns]
    x = a.select(*pages, "i", F.col("j").alias("k"), F.col("v").alias("x"))
    y = b.select(*pages, F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return x.join(y, [*pages, "k"]).groupBy(*pages, "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


pagemtimes = mtimes


def mpower(a: DataFrame, p: int, n: int) -> DataFrame:
    """Repeated squaring."""
    out = eye(a.sparkSession, n)
    while p:
        out = mtimes(out, a) if p & 1 else out
        p >>= 1
        a = mtimes(a, a) if p else a
    return out


def eye(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def kron(a: DataFrame, b: DataFrame, rows_b: int, cols_b: int) -> DataFrame:
    x, y = a.alias("x"), b.alias("y")
    return x.crossJoin(y).select(((F.col("x.i") - 1) * rows_b + F.col("y.i")).alias("i"), ((F.col("x.j") - 1) * cols_b + F.col("y.j")).alias("j"), (F.col("x.v") * F.col("y.v")).alias("v"))


def tril(m: DataFrame, k: int = 0) -> DataFrame:
    return m.filter(F.col("j") - F.col("i") <= k)


def triu(m: DataFrame, k: int = 0) -> DataFrame:
    return m.filter(F.col("j") - F.col("i") >= k)


def diag(m: DataFrame, k: int = 0) -> DataFrame:
    return m.filter(F.col("j") - F.col("i") == k).select("i", "v")


def trace(m: DataFrame) -> DataFrame:
    return m.filter("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def flipud(m: DataFrame, rows: int) -> DataFrame:
    return m.withColumn("i", rows + 1 - F.col("i"))


def fliplr(m: DataFrame, cols: int) -> DataFrame:
    return m.withColumn("j", cols + 1 - F.col("j"))


def rot90(m: DataFrame, cols: int) -> DataFrame:
    """A quarter turn counter-clockwise."""
    return m.select((cols + 1 - F.col("j")).alias("i"), F.col("i").alias("j"), "v")


def reshape(m: DataFrame, rows: int, new_rows: int) -> DataFrame:
    k = (F.col("j") - 1) * rows + F.col("i") - 1
    return m.select((k % new_rows + 1).alias("i"), (F.floor(k / new_rows) + 1).alias("j"), "v")


def toeplitz(spark: SparkSession, column: Sequence[float]) -> DataFrame:
    """A symmetric Toeplitz matrix of its first column."""
    n = len(column)
    c = F.array(*[F.lit(float(x)) for x in column])
    g = spark.range(1, n + 1).select(F.col("id").alias("i")).crossJoin(spark.range(1, n + 1).select(F.col("id").alias("j")))
    return g.withColumn("v", F.get(c, F.abs(F.col("i") - F.col("j")).cast("int")))


def meshgrid(spark: SparkSession, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    x = spark.createDataFrame([(j + 1, float(v)) for j, v in enumerate(xs)], "j long, x double")
    y = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(ys)], "i long, y double")
    return y.crossJoin(x)


def norms(m: DataFrame) -> DataFrame:
    """One, infinity and Frobenius norms."""
    col = m.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("one"))
    row = m.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("inf"))
    return col.crossJoin(row).crossJoin(m.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("fro")))


def vecnorm(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def bandwidth(m: DataFrame) -> DataFrame:
    nz = F.col("v") != 0
    return m.agg(F.coalesce(F.max(F.when(nz, F.greatest(F.col("i") - F.col("j"), F.lit(0)))), F.lit(0)).alias("lower"), F.coalesce(F.max(F.when(nz, F.greatest(F.col("j") - F.col("i"), F.lit(0)))), F.lit(0)).alias("upper"))


def structure(m: DataFrame) -> DataFrame:
    """isdiag, istril, istriu and issymmetric in one row."""
    b = bandwidth(m)
    o = m.filter("v <> 0").alias("a").join(m.filter("v <> 0").alias("b"), (F.col("a.i") == F.col("b.j")) & (F.col("a.j") == F.col("b.i")), "left")
    s = o.agg(F.coalesce(F.bool_and(F.coalesce(F.col("a.v") == F.col("b.v"), F.lit(False))), F.lit(True)).alias("issymmetric"))
    return b.crossJoin(s).select(((F.col("lower") == 0) & (F.col("upper") == 0)).alias("isdiag"), (F.col("upper") == 0).alias("istril"), (F.col("lower") == 0).alias("istriu"), "issymmetric")


# Small matrices ----------------------------------------------------------------------------------

SMALL: dict[str, Callable] = {
    "det": np.linalg.det, "inv": np.linalg.inv, "pinv": np.linalg.pinv, "rank": np.linalg.matrix_rank, "cond": np.linalg.cond, "chol": lambda a: np.linalg.cholesky(a).T,
    "qr": np.linalg.qr, "svd": np.linalg.svd, "eig": np.linalg.eig, "mldivide": lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0], "mrdivide": lambda b, a: np.linalg.lstsq(a.T, b.T, rcond=None)[0].T,
    "rcond": lambda a: 1 / (np.linalg.norm(a, 1) * np.linalg.norm(np.linalg.inv(a), 1)), "null": lambda a: _null(a), "lu": lambda a: lu(a), "rref": lambda a: rref(a), "roots": np.roots,
}


def _null(a: np.ndarray) -> np.ndarray:
    _, s, v = np.linalg.svd(a)
    return v[(s > max(a.shape) * np.finfo(float).eps * s.max(initial=0)).sum() :].T


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partial pivoting: P A = L U."""
    u = np.array(a, float)
    n = len(u)
    low, perm = np.eye(n), np.arange(n)
    for k in range(min(u.shape) - (u.shape[0] <= u.shape[1])):
        p = k + int(np.argmax(np.abs(u[k:, k])))
        if u[p, k] == 0:
            continue
        u[[k, p]], perm[[k, p]] = u[[p, k]], perm[[p, k]]
        low[[k, p], :k] = low[[p, k], :k]
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return low, np.triu(u), np.eye(n)[perm]


def rref(a: np.ndarray) -> np.ndarray:
    m = np.array(a, float)
    r = 0
    for c in range(m.shape[1]):
        if r == len(m):
            break
        p = r + int(np.argmax(np.abs(m[r:, c])))
        if abs(m[p, c]) < 1e-12:
            continue
        m[[r, p]] = m[[p, r]]
        m[r] /= m[r, c]
        others = np.arange(len(m)) != r
        m[others] -= np.outer(m[others, c], m[r])
        r += 1
    return m


# Tall tables -------------------------------------------------------------------------------------


def gram(df: DataFrame, variables: Sequence[str], response: str | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and rows without NaN, in one pass of partial aggregates."""
    cols = [num(v) for v in variables]
    y = num(response) if response else F.lit(0.0)
    ok = ~F.isnan(y)
    for c in cols:
        ok = ok & ~F.isnan(c)
    d = df.filter(ok)
    k = len(cols)
    aggs = [F.sum(cols[a] * cols[b]).alias(f"g{a}_{b}") for a in range(k) for b in range(a, k)]
    aggs += [F.sum(c * y).alias(f"r{a}") for a, c in enumerate(cols)]
    row = d.agg(*aggs, F.sum(y * y).alias("yy"), F.count(F.lit(1)).alias("n")).first()
    g = np.zeros((k, k))
    for a in range(k):
        for b in range(a, k):
            g[a, b] = g[b, a] = row[f"g{a}_{b}"] or 0.0
    return g, np.array([row[f"r{a}"] or 0.0 for a in range(k)]), row["yy"] or 0.0, row["n"]


def regress(df: DataFrame, response: str, variables: Sequence[str]) -> dict:
    """Least squares with intercept: b, r2, n."""
    d = df.withColumn("__1", F.lit(1.0))
    g, r, yy, n = gram(d, ["__1", *variables], response)
    b = np.linalg.lstsq(g, r, rcond=None)[0]
    mean = r[0] / n if n else np.nan
    sst, sse = yy - n * mean * mean, yy - b @ r
    return {"b": b, "r2": 1 - sse / sst if sst else np.nan, "n": n, "sse": sse}


def ridge(df: DataFrame, response: str, variables: Sequence[str], k: float) -> np.ndarray:
    """Coefficients on raw variables with an intercept that is not penalised."""
    g, r, _, _ = gram(df.withColumn("__1", F.lit(1.0)), ["__1", *variables], response)
    return np.linalg.solve(g + k * np.diag([0.0] + [1.0] * len(variables)), r)


def polyfit(df: DataFrame, x: str, y: str, degree: int) -> np.ndarray:
    """Highest power first."""
    names = [f"__{k}" for k in range(degree + 1)]
    d = df.withColumns({n: F.pow(num(x), F.lit(float(k))) for k, n in enumerate(names)})
    g, r, _, _ = gram(d, names, y)
    return np.linalg.lstsq(g, r, rcond=None)[0][::-1]


def pca(df: DataFrame, variables: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Principal directions (columns) and variances from one pass."""
    g, s, _, n = gram(df.withColumn("__1", F.lit(1.0)), ["__1", *variables])
    del s
    mean = g[0, 1:] / n
    c = (g[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)
    w, v = np.linalg.eigh(c)
    return v[:, ::-1], w[::-1]
