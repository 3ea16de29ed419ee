"""Statistics and learning: confusion, folds, encoding, distances, clustering, tests, random variates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import arrays
from tabulon.functions.elementwise import NAN, num
from tabulon.functions.special import tcdf_


def confusionmat(df: DataFrame, truth: str, predicted: str, order: Sequence) -> DataFrame:
    """Counts for every pair of listed labels; rows with a missing label are ignored."""
    d = df.sparkSession
    kind = df.schema[truth].dataType.simpleString()
    lab = d.createDataFrame([(i + 1, v) for i, v in enumerate(order)], f"k int, label {kind}")
    grid = lab.select(F.col("k").alias("i"), F.col("label").alias("t")).crossJoin(lab.select(F.col("k").alias("j"), F.col("label").alias("p")))
    n = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    return grid.join(n, ["t", "p"], "left").select("i", "j", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def crossvalind(df: DataFrame, k: int, row: Sequence[str], classes: Sequence[str] = (), seed: int = 1, name: str = "fold") -> DataFrame:
    """Folds 1..k of nearly equal size, within classes if given; the shuffle is by hash, so reruns agree."""
    key = F.xxhash64(F.lit(seed), *row)
    if classes:
        w = Window.partitionBy(*classes).orderBy(key, *row)
        return df.withColumn(name, ((F.row_number().over(w) - 1) % k + 1).cast("int"))
    from tabulon.operators.table import number_rows

    return number_rows(df.withColumn("__h", key), ["__h", *row], "__n").withColumn(name, ((F.col("__n") - 1) % k + 1).cast("int")).drop("__h", "__n")


def holdout(df: DataFrame, share: float, row: Sequence[str], seed: int = 1, name: str = "train") -> DataFrame:
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *row), 11) / float(1 << 53)
    return df.withColumn(name, u >= share)


def onehot(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """One 0/1 column for each class; an unknown label has zeros."""
    return df.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == F.lit(c)).cast("int"), F.lit(0)) for c in classes})


def onehotdecode(df: DataFrame, columns: Sequence[str], classes: Sequence[str], name: str = "label") -> DataFrame:
    out = F.lit(None).cast("string")
    for c, v in zip(reversed(list(columns)), reversed(list(classes)), strict=True):
        out = F.when(F.col(c) == 1, F.lit(v)).otherwise(out)
    return df.withColumn(name, out)


def knnsearch(points: DataFrame, queries: DataFrame, point_id: str, query_id: str, vector: str, k: int = 1, metric: str = "euclidean", block: int = 2048) -> DataFrame:
    """The k nearest points of each query: query blocks meet all points in numpy; partial top-k, then a merge.

    Queries are the stated small side: blocks of them are collected into rows and joined to every
    partition of the points, where only k candidates for each query leave a task.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    blocks = queries.select(F.pmod(F.xxhash64(query_id), F.lit(max(1, queries.count() // block))).alias("b"), F.struct(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).alias("s"))
    blocks = blocks.groupBy("b").agg(F.collect_list("s").alias("s"))
    parts = points.select(F.pmod(F.xxhash64(point_id), F.lit(64)).alias("c"), F.struct(F.col(point_id).cast("long").alias("p"), F.col(vector).cast("array<double>").alias("v")).alias("s"))
    parts = parts.withColumn("d", F.floor(F.rand(7) * 16)).groupBy("c", "d").agg(F.collect_list("s").alias("t"))

    def near(batches):
        for pdf in batches:
            out = []
            for s, t in zip(pdf["s"], pdf["t"], strict=True):
                x, y = np.array([r["v"] for r in s]), np.array([r["v"] for r in t])
                if metric == "cosine":
                    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
                    d = 1 - x @ y.T
                else:
                    d = np.sqrt(np.maximum(((x[:, None, :] - y[None, :, :]) ** 2).sum(2), 0)) if x.size * len(y) < 5e7 else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
                ids = np.array([r["p"] for r in t])
                for i, r in enumerate(s):
                    best = np.lexsort((ids, d[i]))[:k]
                    out.append(pd.DataFrame({"q": r["q"], "p": ids[best], "distance": d[i][best]}))
            yield pd.concat(out) if out else pd.DataFrame({"q": [], "p": [], "distance": []})

    met = blocks.crossJoin(parts.drop("c", "d")).select("s", "t").mapInPandas(near, "q long, p long, distance double")
    w = Window.partitionBy("q").orderBy("distance", "p")
    return met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(F.col("q").alias(query_id), "place", F.col("p").alias("neighbour"), "distance")


def pdist(df: DataFrame, row: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """Distances of all pairs of rows of a small table."""
    a, b = df.select(F.col(row).alias("a"), F.col(vector).alias("x")), df.select(F.col(row).alias("b"), F.col(vector).alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", arrays.distance("x", "y", metric).alias("distance"))


pdist2 = pdist


def kmeans(df: DataFrame, row: str, vector: str, start: Sequence[Sequence[float]], rounds: int = 50) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's algorithm; each round is one aggregate, and only k centres reach the driver."""
    c = np.asarray(start, float)
    v = F.col(vector).cast("array<double>")
    dim = c.shape[1]

    def label(c: np.ndarray) -> Column:
        d = [F.struct(arrays.distance(v, F.array(*[F.lit(float(t)) for t in r]), "squaredeuclidean").alias("d"), F.lit(i + 1).alias("k")) for i, r in enumerate(c)]
        return (F.least(*d) if len(d) > 1 else d[0])["k"]

    for _ in range(rounds):
        got = df.withColumn("k", label(c)).groupBy("k").agg(*[F.avg(F.get(v, F.lit(j))).alias(f"m{j}") for j in range(dim)]).collect()
        new = c.copy()
        for r in got:
            new[r.k - 1] = [r[f"m{j}"] for j in range(dim)]
        done = np.allclose(new, c, rtol=0, atol=1e-12)
        c = new
        if done:
            break
    return df.select(row, label(c).alias("label")), c


def ttest2(df: DataFrame, value: str, group: str) -> dict:
    """Two-sample t test with pooled variance."""
    s = {r["g"]: r for r in df.filter(~F.isnan(num(value))).groupBy(F.col(group).alias("g")).agg(F.avg(num(value)).alias("m"), F.var_samp(num(value)).alias("v"), F.count("*").alias("n")).limit(3).collect()}
    if len(s) != 2:
        raise ValueError("two groups are needed")
    a, b = (s[k] for k in sorted(s))
    nu = a.n + b.n - 2
    sp = ((a.n - 1) * a.v + (b.n - 1) * b.v) / nu
    t = (a.m - b.m) / math.sqrt(sp * (1 / a.n + 1 / b.n))
    return {"t": t, "df": nu, "p": 2 * tcdf_(-abs(t), nu)}


def perfcurve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """ROC points (score, fpr, tpr) by falling score, from counts of distinct scores."""
    from tabulon.operators.windows import running

    v = df.groupBy(num(score).alias("score")).agg(F.sum(F.when(F.col(truth), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(truth), 0).otherwise(1)).alias("n")).withColumn("__o", -F.col("score"))
    total = v.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    v = running(running(v, "p", ["__o"], (), "tp"), "n", ["__o"], (), "fp")
    return v.crossJoin(F.broadcast(total)).select("score", (F.col("fp") / F.col("all_n")).alias("fpr"), (F.col("tp") / F.col("all_p")).alias("tpr"))


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks."""
    from tabulon.operators.grouping import tiedrank

    r = tiedrank(df, score)
    p, n = F.sum(F.when(F.col(truth), 1).otherwise(0)), F.sum(F.when(F.col(truth), 0).otherwise(1))
    return r.agg(((F.sum(F.when(F.col(truth), F.col("rank")).otherwise(0.0)) - p * (p + 1) / 2) / (p * n)).alias("auc"))


def bootstrp(df: DataFrame, rounds: int, statistic: Column, seed: int = 1) -> DataFrame:
    """A statistic on Poisson resamples; all rounds in one pass over expanded counts."""
    d = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = F.rand(seed)
    n = F.when(u < 0.36788, 0).when(u < 0.73576, 1).when(u < 0.91970, 2).when(u < 0.98101, 3).when(u < 0.99634, 4).otherwise(5)
    d = d.withColumn("__n", n).filter("__n > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n", "__c")
    return d.groupBy("round").agg(statistic.alias("value"))


# Random variates ---------------------------------------------------------------------------------


def rand(seed: int) -> Column:
    return F.rand(seed)


def randn(seed: int) -> Column:
    return F.randn(seed)


def randi(lo: int, hi: int, seed: int) -> Column:
    return F.floor(F.rand(seed) * (hi - lo + 1)).cast("long") + lo


def unifrnd(a: float, b: float, seed: int) -> Column:
    return a + (b - a) * F.rand(seed)


def normrnd(mu: float, sigma: float, seed: int) -> Column:
    return mu + sigma * F.randn(seed)


def exprnd(mu: float, seed: int) -> Column:
    return -mu * F.log1p(-F.rand(seed))


def wblrnd(a: float, b: float, seed: int) -> Column:
    return a * F.pow(-F.log1p(-F.rand(seed)), F.lit(1 / b))


def binornd(n: int, p: float, seed: int) -> Column:
    return sum(F.when(F.rand(seed + k) < p, 1).otherwise(0) for k in range(n))


def trnd(nu: int, seed: int) -> Column:
    chi = sum(F.pow(F.randn(seed + 1 + k), F.lit(2.0)) for k in range(nu))
    return F.randn(seed) / F.sqrt(chi / nu)


def gamrnd(shape: float, scale: float, seed: int) -> Column:
    @F.pandas_udf("double")
    def draw(u: pd.Series) -> pd.Series:
        # One generator a batch, seeded by its first uniform, so retries agree.
        rng = np.random.default_rng(int(u.iloc[0] * (1 << 53))) if len(u) else np.random.default_rng(0)
        return pd.Series(rng.gamma(shape, scale, len(u)))

    return draw(F.rand(seed))


def montecarlo_call(df: DataFrame, s0: float, strike: float, rate: float, vol: float, t: float, seed: int) -> DataFrame:
    """Price of a European call: geometric Brownian paths in closed form, one draw a path."""
    s = s0 * F.exp(F.lit((rate - vol * vol / 2) * t) + vol * math.sqrt(t) * F.randn(seed))
    return df.select(s.alias("s")).agg((F.avg(F.greatest(F.col("s") - strike, F.lit(0.0))) * math.exp(-rate * t)).alias("price"))


def nan_if_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))
