"""Cumulative, moving and neighbour operators over ordered rows.

Ordered operators take `order`, which must be a total order, and `groups` (series).  Without groups a
prefix scan runs in two levels: rows are dealt to key ranges, scanned inside them, and the totals of
the ranges before are added, so that no task sees all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.elementwise import INF, NAN, finite, num

#: Rows of the key sample behind range cuts, and ranges at most; within these bounds the shuffle partitions decide.
SAMPLE, RANGES = 16_384, 512


def spread(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds __p, the number of the key range of a row. Cuts come from a bounded sample picked by hash, so reruns agree."""
    keys = df.select(*order).orderBy(F.xxhash64(*order)).limit(SAMPLE).orderBy(*order).collect()
    parts = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, len(keys)))
    kind = "struct<" + ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in order) + ">"
    cuts = sorted({len(keys) * k // parts for k in range(1, parts)})
    if not cuts:
        return df.withColumn("__p", F.lit(0))
    at = F.array(*[F.struct(*[F.lit(keys[k][c]).alias(c) for c in order]).cast(kind) for k in cuts])
    key = F.struct(*[F.col(c).alias(c) for c in order]).cast(kind)
    return df.withColumn("__p", F.size(F.filter(at, lambda c: c < key)))


def _series(groups: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*groups).orderBy(*order)


def running(df: DataFrame, value: str | Column, order: Sequence[str], groups: Sequence[str] = (), name: str = "running", how: str = "sum") -> DataFrame:
    """Adds the prefix sum, min or max of a value."""
    f = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    v = F.col(value) if isinstance(value, str) else value
    if groups:
        return df.withColumn(name, f(v).over(_series(groups, order).rowsBetween(Window.unboundedPreceding, 0)))
    s = spread(df.withColumn("__rv", v), order)
    inside = f("__rv").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = s.groupBy("__p").agg(f("__rv").alias("__t"))
    # At most RANGES rows.
    before = before.select("__p", f("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__b"))
    both = s.withColumn("__i", inside).join(F.broadcast(before), "__p")
    total = {"sum": F.col("__i") + F.coalesce("__b", F.lit(0)), "min": F.least("__i", "__b"), "max": F.greatest("__i", "__b")}[how]
    return both.withColumn(name, total).drop("__p", "__i", "__b", "__rv")


def cumsum(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), omit: bool = False, name: str = "cumsum") -> DataFrame:
    """A NaN spoils all later sums, unless omitted."""
    x = num(column)
    return running(df, F.when(F.isnan(x), 0.0).otherwise(x) if omit else x, order, groups, name)


def cumprod(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), name: str = "cumprod") -> DataFrame:
    """By running sums of logarithms, signs, zeros and NaNs."""
    x = num(column)
    parts = F.struct(
        F.when(x == 0, 0.0).otherwise(F.ln(F.when((x != 0) & ~F.isnan(x), F.abs(x)))).alias("l"),
        F.when(x < 0, 1).otherwise(0).alias("s"),
        F.when(x == 0, 1).otherwise(0).alias("z"),
        F.when(F.isnan(x), 1).otherwise(0).alias("n"),
    )
    out = df.withColumn("__x", parts)
    for k in "lszn":
        out = running(out, F.coalesce(F.col(f"__x.{k}"), F.lit(0)), order, groups, f"__{k}")
    y = F.when(F.col("__n") > 0, F.lit(NAN)).when(F.col("__z") > 0, 0.0).otherwise(F.exp("__l") * F.when(F.col("__s") % 2 == 1, -1.0).otherwise(1.0))
    return out.withColumn(name, y).drop("__x", "__l", "__s", "__z", "__n")


def cummax(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), name: str = "cummax") -> DataFrame:
    """NaN is skipped; NaN until a number comes."""
    x = num(column)
    out = running(df, F.when(~F.isnan(x), x), order, groups, name, "max")
    return out.withColumn(name, F.coalesce(name, F.lit(NAN)))


def cummin(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), name: str = "cummin") -> DataFrame:
    x = num(column)
    out = running(df, F.when(~F.isnan(x), x), order, groups, name, "min")
    return out.withColumn(name, F.coalesce(name, F.lit(NAN)))


def diff(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), n: int = 1, name: str = "diff") -> DataFrame:
    """n-th difference; the first n rows of a series have none and go."""
    w, x = _series(groups, order), num(column)
    y = sum((-1) ** k * math.comb(n, k) * F.lag(x, k).over(w) for k in range(n + 1))
    return df.withColumn(name, y).filter(F.col(name).isNotNull())


def gradient(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str] = (), step: float = 1.0, name: str = "gradient") -> DataFrame:
    w, x = _series(groups, order), num(column)
    b, a = F.lag(x).over(w), F.lead(x).over(w)
    y = F.when(b.isNull() & a.isNull(), 0.0).when(b.isNull(), (a - x) / step).when(a.isNull(), (x - b) / step).otherwise((a - b) / (2 * step))
    return df.withColumn(name, y)


def trapz(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """Trapezoidal integral of y over x in each series."""
    w = _series(groups, [x])
    a, b = num(x), num(y)
    d = df.withColumn("__d", (a - F.lag(a).over(w)) * (b + F.lag(b).over(w)) / 2)
    return d.groupBy(*groups).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("integral"))


def cumtrapz(df: DataFrame, x: str, y: str, groups: Sequence[str], name: str = "integral") -> DataFrame:
    w = _series(groups, [x])
    a, b = num(x), num(y)
    d = df.withColumn("__d", F.coalesce((a - F.lag(a).over(w)) * (b + F.lag(b).over(w)) / 2, F.lit(0.0)))
    return running(d, "__d", [x], groups, name).drop("__d")


def moving(df: DataFrame, column: str, k: int, method: str, order: Sequence[str], groups: Sequence[str], name: str = "moving") -> DataFrame:
    """Centred moving statistic over k rows (k even: one more before); windows shrink at the ends; NaN omitted."""
    before, after = (k // 2, (k - 1) // 2)
    w = _series(groups, order).rowsBetween(-before, after)
    x = num(column)
    v = F.when(~F.isnan(x), x)
    if method == "mad":
        a = F.collect_list(v).over(w)
        m = _array_median(a)
        return df.withColumn("__a", a).withColumn("__m", m).withColumn(name, F.coalesce(_array_median(F.transform("__a", lambda t: F.abs(t - F.col("__m")))), F.lit(NAN))).drop("__a", "__m")
    y = {
        "mean": lambda: F.avg(v).over(w),
        "sum": lambda: F.coalesce(F.sum(v).over(w), F.lit(0.0)),
        "min": lambda: F.min(v).over(w),
        "max": lambda: F.max(v).over(w),
        "std": lambda: F.coalesce(F.stddev_samp(v).over(w), F.when(F.count(v).over(w) > 0, 0.0)),
        "var": lambda: F.coalesce(F.var_samp(v).over(w), F.when(F.count(v).over(w) > 0, 0.0)),
        "prod": lambda: F.product(v).over(w),
        "median": lambda: _array_median(F.collect_list(v).over(w)),
    }[method]()
    return df.withColumn(name, F.coalesce(y, F.lit(NAN)))


def _array_median(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(s)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(s, lo) + F.get(s, hi)) / 2


def unwrap(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str], tol: float = math.pi, name: str = "unwrapped") -> DataFrame:
    """Jumps beyond tol are taken back by whole turns; steps beside non-finite values count as none."""
    from tabulon.functions.elementwise import mod

    x = num(column)
    d = x - F.lag(x).over(_series(groups, order))
    turned = mod(d + math.pi, 2 * math.pi) - math.pi
    turned = F.when((turned == -math.pi) & (d > 0), F.lit(math.pi)).otherwise(turned)
    fix = F.when(d.isNotNull() & finite(F.coalesce(d, F.lit(NAN))) & (F.abs(d) > tol), turned - d).otherwise(0.0)
    out = running(df.withColumn("__f", fix), "__f", order, groups, "__c")
    return out.withColumn(name, x + F.col("__c")).drop("__f", "__c")


def macd(df: DataFrame, price: str, order: Sequence[str], groups: Sequence[str], fast: float = 0.15, slow: float = 0.075, signal: float = 0.2) -> DataFrame:
    """MACD line and signal by exponential averages seeded with the first price; a series must fit in a row."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        p = pdf[price].astype(float)
        # adjust=False is the plain recurrence; skipping is off so that NaN goes on.
        line = _ema(p.to_numpy(), fast) - _ema(p.to_numpy(), slow)
        return pdf[[*groups, *order]].assign(macd=line, signal=_ema(line, signal))

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*groups, *order)) + ", macd double, signal double"
    return df.select(*groups, *order, price).groupBy(*groups).applyInPandas(run, schema)


def _ema(x, alpha: float):
    import numpy as np

    out = np.empty(len(x))
    at = x[0] if len(x) else 0.0
    for i, v in enumerate(x):
        at = v if i == 0 else at + alpha * (v - at)
        out[i] = at
    return out


def rescale(df: DataFrame, column: str, groups: Sequence[str] = (), lo: float = 0.0, hi: float = 1.0, name: str = "rescaled") -> DataFrame:
    """Linear map of [min, max] to [lo, hi] in each group; a constant group maps to lo.  Aggregate and join, no global window."""
    x = num(column)
    v = F.when(~F.isnan(x), x)
    return _with_stats(df, groups, [F.min(v).alias("__a"), F.max(v).alias("__b")]).withColumn(name, F.when(F.col("__b") > F.col("__a"), lo + (x - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0)) * (hi - lo)).otherwise(F.lit(lo))).drop("__a", "__b")


def normalize(df: DataFrame, column: str, groups: Sequence[str] = (), method: str = "zscore", name: str = "normalized") -> DataFrame:
    x = num(column)
    v = F.when(~F.isnan(x), x)
    if method == "range":
        return rescale(df, column, groups, name=name)
    if method == "norm":
        out = _with_stats(df, groups, [F.lit(0.0).alias("__a"), F.sqrt(F.sum(v * v)).alias("__b")])
    else:
        out = _with_stats(df, groups, [F.avg(v).alias("__a"), F.stddev_samp(v).alias("__b")])
    return out.withColumn(name, F.when(F.col("__b") > 0, (x - F.col("__a")) / F.nullif(F.col("__b"), F.lit(0.0))).otherwise(0.0)).drop("__a", "__b")


def _with_stats(df: DataFrame, groups: Sequence[str], aggs: list[Column]) -> DataFrame:
    s = df.groupBy(*groups).agg(*aggs)
    return df.join(s, list(groups)) if groups else df.crossJoin(F.broadcast(s))  # one row


def fillmissing(df: DataFrame, column: str, method: str, order: Sequence[str], groups: Sequence[str], name: str = "filled") -> DataFrame:
    """previous, next, nearest, or linear over the row number (extended at the ends by the nearest pair's line)."""
    x = num(column)
    w = _series(groups, order)
    v = F.when(~F.isnan(x), x)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("__k", F.row_number().over(w)).withColumn("__v", v)
    at = F.when(F.col("__v").isNotNull(), F.struct(F.col("__k").alias("k"), F.col("__v").alias("v")))
    df = df.withColumn("__p", F.last(at, True).over(back)).withColumn("__n", F.first(at, True).over(ahead))
    p, n, k = F.col("__p"), F.col("__n"), F.col("__k")
    if method == "previous":
        y = p["v"]
    elif method == "next":
        y = n["v"]
    elif method == "nearest":
        y = F.when(n.isNull() | (k - p["k"] < n["k"] - k), p["v"]).otherwise(F.coalesce(n["v"], p["v"]))
    elif method == "linear":
        df = df.withColumn("__pp", F.last(F.when(F.col("__v").isNotNull(), F.lag(F.col("__p")).over(w)), True).over(back)).withColumn("__nn", F.first(F.when(F.col("__v").isNotNull(), F.lead(F.col("__n")).over(w)), True).over(ahead))
        line = lambda a, b: a["v"] + (b["v"] - a["v"]) * (k - a["k"]) / F.nullif(b["k"] - a["k"], F.lit(0))
        y = F.when(p.isNotNull() & n.isNotNull(), F.when(p["k"] == n["k"], p["v"]).otherwise(line(p, n))).when(n.isNotNull(), F.coalesce(line(n, F.col("__nn")), n["v"])).otherwise(F.coalesce(line(F.col("__pp"), p), p["v"]))
    else:
        raise ValueError(f"unknown method {method}")
    return df.withColumn(name, F.coalesce(F.col("__v"), y, F.lit(NAN))).drop("__k", "__v", "__p", "__n", "__pp", "__nn")


def isoutlier(df: DataFrame, column: str, groups: Sequence[str] = (), factor: float = 3.0, name: str = "outlier") -> DataFrame:
    """More than `factor` scaled median absolute deviations from the median."""
    x = num(column)
    v = F.when(~F.isnan(x), x)
    one = _with_stats(df, groups, [F.median(v).alias("__m")])
    d = F.abs(x - F.col("__m"))
    s = one.groupBy(*groups).agg(F.median(F.when(~F.isnan(x), d)).alias("__s"))
    two = one.join(s, list(groups)) if groups else one.crossJoin(F.broadcast(s))
    return two.withColumn(name, F.coalesce((d > factor * 1.4826 * F.col("__s")) & ~F.isnan(x), F.lit(False))).drop("__m", "__s")


def filloutliers(df: DataFrame, column: str, method: str, order: Sequence[str], groups: Sequence[str], name: str = "filled") -> DataFrame:
    out = isoutlier(df, column, groups, name="__o").withColumn("__c", F.when(F.col("__o"), F.lit(NAN)).otherwise(num(column)))
    return fillmissing(out, "__c", method, order, groups, name).drop("__o", "__c")


def interp1(points: DataFrame, queries: DataFrame, x: str, y: str, q: str, method: str = "linear", groups: Sequence[str] = (), extrapolate: bool = False) -> DataFrame:
    """Values at query places, an as-of join on both sides: one union, two running fills.

    linear, nearest (halves go up), previous, next; NaN outside the points unless extrapolated (linear).
    """
    a = points.select(*groups, num(x).alias("__x"), num(y).alias("__y"), F.lit(0).alias("__q"))
    b = queries.select(*groups, num(q).alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__q"))
    u = a.unionByName(b).withColumn("__at", F.when(F.col("__q") == 0, F.struct(F.col("__x").alias("x"), F.col("__y").alias("y"))))
    near = lambda w: F.last("__at", True).over(w.rowsBetween(Window.unboundedPreceding, 0))  # noqa: E731  running both ways, so linear
    if groups:
        w = Window.partitionBy(*groups)
        u = u.withColumn("__p", near(w.orderBy("__x", "__q"))).withColumn("__n", near(w.orderBy(F.desc("__x"), F.desc("__q"))))
        if extrapolate:
            ends = a.groupBy(*groups).agg(F.sort_array(F.collect_set("__x")).alias("__e"))
            ends = a.join(ends.select(*groups, F.slice("__e", 1, 2).alias("__lo"), F.slice("__e", F.greatest(F.size("__e") - 1, F.lit(1)), F.lit(2)).alias("__hi")), list(groups))
            ends = ends.groupBy(*groups).agg(*[F.max(F.when(F.col("__x") == F.get(side, F.lit(i)), F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))).alias(k) for k, side, i in (("__nn", "__lo", 1), ("__pp", "__hi", 0))])
            u = u.join(ends, list(groups), "left")
    else:
        # Fills inside key ranges; what lies before and after a range comes from one row for each, RANGES at most.
        w = Window.partitionBy("__r")
        u = spread(u, ["__x", "__q"]).withColumnRenamed("__p", "__r")
        u = u.withColumn("__p", near(w.orderBy("__x", "__q"))).withColumn("__n", near(w.orderBy(F.desc("__x"), F.desc("__q"))))
        ends = u.groupBy("__r").agg(F.min("__at").alias("__lo"), F.max("__at").alias("__hi"))
        up, down = Window.orderBy("__r"), Window.orderBy(F.desc("__r"))
        ends = ends.select("__r", F.last("__hi", True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.last("__lo", True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("__after"))
        u = u.join(F.broadcast(ends), "__r").withColumn("__p", F.coalesce("__p", "__before")).withColumn("__n", F.coalesce("__n", "__after"))
        if extrapolate:
            point = a.filter(~F.isnan("__x")).groupBy("__x").agg(F.max("__y").alias("__y"))
            pick = lambda rows: F.struct(F.lit(rows[1][0]).alias("x"), F.lit(rows[1][1]).alias("y")) if len(rows) > 1 else F.lit(None).cast("struct<x:double,y:double>")
            u = u.withColumn("__nn", pick(point.orderBy("__x").limit(2).collect())).withColumn("__pp", pick(point.orderBy(F.desc("__x")).limit(2).collect()))
    u = u.filter("__q = 1")
    p, n, t = F.col("__p"), F.col("__n"), F.col("__x")
    line = lambda c, d: c["y"] + (d["y"] - c["y"]) * (t - c["x"]) / F.nullif(d["x"] - c["x"], F.lit(0.0))
    inside = p.isNotNull() & n.isNotNull()
    exact = p.isNotNull() & (p["x"] == t)
    body = {
        "linear": line(p, n),
        "nearest": F.when(t - p["x"] < n["x"] - t, p["y"]).otherwise(n["y"]),
        "previous": p["y"],
        "next": n["y"],
    }[method]
    out = F.when(exact, p["y"]).when(inside, body)
    if extrapolate:
        out = out.when(p.isNull(), line(n, F.col("__nn"))).when(n.isNull(), line(F.col("__pp"), p))
    return u.select(*groups, F.col("__x").alias(q), F.coalesce(F.when(F.isnan(t), F.lit(NAN)).otherwise(out), F.lit(NAN)).alias(y))


def asof_join(left: DataFrame, right: DataFrame, on: str, groups: Sequence[str], value: str) -> DataFrame:
    """The last right value at or before each left time, by one union and a forward fill."""
    l = left.select(*left.columns, F.lit(1).alias("__s"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))  # noqa: E741
    r = right.select(*groups, on, F.lit(0).alias("__s"), F.col(value).alias("__v"))
    u = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*groups).orderBy(on, "__s").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn(value, F.last("__v", True).over(w)).filter("__s = 1").drop("__s", "__v")
