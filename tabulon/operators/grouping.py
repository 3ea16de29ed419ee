"""Grouped summaries, cross-tables, reductions, order statistics and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.elementwise import INF, NAN, finite, num
from tabulon.functions.special import tinv_
from tabulon.operators.table import number_rows


def _ok(x: Column) -> Column:
    """The value where it is a number, else NULL, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def reduce_(x, method: str, omit: bool = True) -> Column:
    """An aggregate with array-language results for empty input; NaN omitted or included."""
    x = num(x)
    v = _ok(x)
    spoiled = F.coalesce(F.bool_or(F.isnan(x)), F.lit(False))
    agg = {
        "sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)),
        "mean": lambda: F.coalesce(F.avg(v), F.lit(NAN)),
        "min": lambda: F.coalesce(F.min(v), F.lit(INF)),
        "max": lambda: F.coalesce(F.max(v), F.lit(-INF)),
        "median": lambda: F.coalesce(F.median(v), F.lit(NAN)),
        "count": lambda: F.count(v),
        "numel": lambda: F.count(F.lit(1)),
        "prod": lambda: F.coalesce(F.product(v), F.lit(1.0)),
        "range": lambda: F.coalesce(F.max(v) - F.min(v), F.lit(NAN)),
        "var": lambda: F.when(F.count(v) == 0, F.lit(NAN)).otherwise(F.coalesce(F.var_samp(v), F.lit(0.0))),
        "std": lambda: F.when(F.count(v) == 0, F.lit(NAN)).otherwise(F.coalesce(F.stddev_samp(v), F.lit(0.0))),
        "varp": lambda: F.coalesce(F.var_pop(v), F.lit(NAN)),
        "nnz": lambda: F.count(F.when(x != 0, 1)),
        "any": lambda: F.coalesce(F.bool_or((x != 0) & ~F.isnan(x)), F.lit(False)),
        "all": lambda: F.coalesce(F.bool_and(x != 0), F.lit(True)),
        "allfinite": lambda: F.coalesce(F.bool_and(finite(x)), F.lit(True)),
        "mode": lambda: F.coalesce(F.mode(v, True), F.lit(NAN)),
        "sumsq": lambda: F.coalesce(F.sum(v * v), F.lit(0.0)),
        "norm": lambda: F.sqrt(F.coalesce(F.sum(v * v), F.lit(0.0))),
        "mad": lambda: F.coalesce(F.avg(F.abs(v)), F.lit(NAN)),
    }[method]()
    return agg if omit or method in ("numel", "nnz", "any", "all", "allfinite", "mode") else F.when(spoiled, F.lit(NAN)).otherwise(agg)


def groupsummary(df: DataFrame, groups: Sequence[str], methods: Sequence[str], variables: Sequence[str] | None = None) -> DataFrame:
    """Groups with GroupCount and method_variable columns; missing keys are a group; NaN is skipped in data.

    Default variables: the numeric ones outside the groups.  One pass with map-side partial aggregates.
    """
    if variables is None:
        variables = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in groups]
    out = [reduce_(v, m).alias(f"{m}_{v}") for m in methods for v in variables]
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("GroupCount"), *out)


def pivot(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, data: str, method: str = "sum") -> DataFrame:
    """Cross-table over listed column keys; a cell without rows is NaN, one with only NaN rows has the method's own result."""
    cells = []
    for v in values:
        own = F.col(column) == F.lit(v)
        x = F.when(own, num(data)).otherwise(F.lit(NAN))
        seen = F.bool_or(own)
        cells.append(F.when(F.coalesce(seen, F.lit(False)), reduce_(x, method)).otherwise(F.lit(NAN)).alias(str(v)))
    return df.groupBy(*rows).agg(*cells)


def pivot_values(df: DataFrame, column: str, order: Sequence[str], most: int = 1000) -> list:
    """Distinct column keys by first appearance; an error beyond `most`, as each becomes a column."""
    first = df.groupBy(column).agg(F.min(F.struct(*order)).alias("at")).orderBy("at").limit(most + 1).collect()
    if len(first) > most:
        raise ValueError(f"more than {most} distinct values of {column}")
    return [r[column] for r in first]


def grpstats(df: DataFrame, groups: Sequence[str], variables: Sequence[str], stats: Sequence[str] = ("mean",), alpha: float = 0.05) -> DataFrame:
    """Statistics by group; rows with a missing key go.  var and std of one value are NaN.

    meanci and predci give arrays of two bounds by the Student t distribution.
    """
    for g in groups:
        missing = F.isnan(g) if isinstance(df.schema[g].dataType, (T.DoubleType, T.FloatType)) else F.lit(False)
        blank = F.col(g) == "" if isinstance(df.schema[g].dataType, T.StringType) else F.lit(False)
        df = df.filter(F.col(g).isNotNull() & ~missing & ~blank)
    cols = []
    t_of = F.udf(lambda n: tinv_(1 - alpha / 2, n - 1) if n and n > 1 else NAN, "double")  # one call for each group
    for v in variables:
        x = _ok(num(v))
        n, mean, var = F.count(x), F.coalesce(F.avg(x), F.lit(NAN)), F.coalesce(F.var_samp(x), F.lit(NAN))
        for s in stats:
            if s in ("meanci", "predci"):
                half = t_of(n) * F.sqrt(var * (F.lit(1.0) / F.nullif(n, F.lit(0)) + (1 if s == "predci" else 0)))
                c = F.array(mean - half, mean + half)
            else:
                c = {"mean": mean, "var": var, "std": F.sqrt(var), "sem": F.sqrt(var / F.nullif(n, F.lit(0))), "min": F.min(x), "max": F.max(x), "range": F.max(x) - F.min(x), "numel": n}[s]
            cols.append(c.alias(f"{s}_{v}"))
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("GroupCount"), *cols)


def accumarray(df: DataFrame, groups: Sequence[str], value: str, method: str = "sum") -> DataFrame:
    return df.groupBy(*groups).agg(reduce_(value, method).alias("value"))


def findgroups(df: DataFrame, keys: Sequence[str], name: str = "group") -> DataFrame:
    """Adds 1-based numbers of the sorted groups; numbering runs over the distinct keys only."""
    ids = number_rows(df.select(*keys).dropDuplicates(), keys, name)
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return df.alias("l").join(ids.alias("r"), on).select("l.*", f"r.{name}")


def splitapply(df: DataFrame, keys: Sequence[str], f, schema: str) -> DataFrame:
    """A pandas function on each group; groups must fit in a task."""
    return df.groupBy(*keys).applyInPandas(f, schema)


# Order statistics --------------------------------------------------------------------------------


def bounds(x, omit: bool = True) -> Column:
    return F.struct(reduce_(x, "min", omit).alias("lo"), reduce_(x, "max", omit).alias("hi"))


def quantile(x, p: float) -> Column:
    """Linear interpolation at p (n - 1); NaN omitted."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    return F.coalesce(F.percentile(_ok(num(x)), F.lit(p)), F.lit(NAN))


def prctile(x, p: float) -> Column:
    return quantile(x, p / 100)


def iqr(x) -> Column:
    return quantile(x, 0.75) - quantile(x, 0.25)


def mode_counts(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Most frequent value (ties: smallest), its frequency and all values that reach it."""
    counts = df.filter(~F.isnan(num(column))).groupBy(*groups, column).agg(F.count("*").alias("n"))
    top = counts.groupBy(*groups).agg(F.max("n").alias("frequency"))
    both = counts.join(top, list(groups)) if groups else counts.crossJoin(F.broadcast(top))  # one row
    ties = both.filter("n = frequency").groupBy(*groups, "frequency").agg(F.min(column).alias("mode"), F.sort_array(F.collect_list(column)).alias("ties"))
    return ties.select(*groups, "mode", "frequency", "ties")


def tiedrank(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Average ranks, NaN for NaN.

    Ranks come from value counts and running sums over distinct values, so ties do not pile up.
    """
    from tabulon.operators.windows import running

    v = df.filter(~F.isnan(num(column))).groupBy(*groups, num(column).alias("__v")).agg(F.count("*").alias("__n"))
    v = running(v, "__n", ["__v"], groups, "__c")
    v = v.withColumn("rank", F.col("__c") - (F.col("__n") - 1) / 2)
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups] + [num(F.col(f"l.{column}")) == F.col("r.__v")]
    return df.alias("l").join(v.alias("r"), on, "left").select("l.*", F.coalesce("r.rank", F.lit(NAN)).alias("rank"))


def tie_adjustment(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    t = df.filter(~F.isnan(num(column))).groupBy(*groups, column).agg(F.count("*").cast("double").alias("t"))
    return t.groupBy(*groups).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("tieadj"))


def ecdf(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Empirical distribution: x, f, survivor, hazard (sum of d / n at risk), without the leading zero point."""
    from tabulon.operators.windows import running

    v = df.filter(~F.isnan(num(column))).groupBy(*groups, num(column).alias("x")).agg(F.count("*").alias("d"))
    total = v.groupBy(*groups).agg(F.sum("d").alias("n"))
    v = running(v, "d", ["x"], groups, "upto")
    v = v.join(total, list(groups)) if groups else v.crossJoin(F.broadcast(total))  # one row
    v = v.withColumn("risk", F.col("n") - F.col("upto") + F.col("d")).withColumn("h", F.col("d") / F.col("risk"))
    v = running(v, "h", ["x"], groups, "hazard")
    return v.select(*groups, "x", (F.col("upto") / F.col("n")).alias("f"), (1 - F.col("upto") / F.col("n")).alias("survivor"), "hazard")


def kaplan_meier(df: DataFrame, time: str, censored: str, groups: Sequence[str] = ()) -> DataFrame:
    """Product-limit survivor function under right censoring."""
    from tabulon.operators.windows import running

    v = df.filter(~F.isnan(num(time))).groupBy(*groups, num(time).alias("x")).agg(F.sum(F.when(F.col(censored), 0).otherwise(1)).alias("d"), F.count("*").alias("c"))
    total = v.groupBy(*groups).agg(F.sum("c").alias("n"))
    v = running(v, "c", ["x"], groups, "upto")
    v = v.join(total, list(groups)) if groups else v.crossJoin(F.broadcast(total))
    v = v.withColumn("risk", F.col("n") - F.col("upto") + F.col("c"))
    v = v.withColumn("l", F.when(F.col("d") < F.col("risk"), F.ln(F.when(F.col("d") < F.col("risk"), 1 - F.col("d") / F.col("risk")))).otherwise(F.lit(-INF)))
    v = running(v, "l", ["x"], groups, "s")
    return v.filter("d > 0").select(*groups, "x", F.exp("s").alias("survivor"))


# Correlation -------------------------------------------------------------------------------------


def cov(a, b) -> Column:
    return F.coalesce(F.covar_samp(num(a), num(b)), F.lit(NAN))


def corr(a, b) -> Column:
    """Pearson; NaN in either column spoils it, and so does zero variance."""
    return F.coalesce(F.corr(num(a), num(b)), F.lit(NAN))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks."""
    r = tiedrank(df, a).withColumnRenamed("rank", "__ra")
    r = tiedrank(r, b).withColumnRenamed("rank", "__rb")
    return r.agg(corr("__ra", "__rb").alias("rho"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Tau-b over value pairs of aggregated counts; meant for columns of few distinct values."""
    v = df.groupBy(num(a).alias("a"), num(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    x, y = v.alias("x"), v.alias("y")
    s = F.signum(F.col("x.a") - F.col("y.a")) * F.signum(F.col("x.b") - F.col("y.b"))
    w = F.col("x.n") * F.col("y.n")
    pair = x.join(y, F.col("x.a") < F.col("y.a")).agg(F.sum(s * w).alias("s"))
    ta = df.groupBy(num(a).alias("a")).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("ta"))
    tb = df.groupBy(num(b).alias("b")).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("tb"))
    n = df.agg(F.count("*").cast("double").alias("n"))
    one = pair.crossJoin(ta).crossJoin(tb).crossJoin(n)  # single rows
    all_ = F.col("n") * (F.col("n") - 1) / 2
    return one.select((-F.col("s") / F.sqrt((all_ - F.col("ta")) * (all_ - F.col("tb")))).alias("tau")).select((-F.col("tau")).alias("tau"))


def corrcoef(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Correlation matrix as (i, j, value) rows from one pass over the data."""
    pairs = [(i, j) for i in range(len(variables)) for j in range(len(variables))]
    one = df.agg(*[corr(variables[i], variables[j]).alias(f"c{i}_{j}") for i, j in pairs if i <= j])
    cells = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("value")) for i, j in pairs])
    return one.select(F.inline(cells))


def covmatrix(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    pairs = [(i, j) for i in range(len(variables)) for j in range(len(variables))]
    one = df.agg(*[cov(variables[i], variables[j]).alias(f"c{i}_{j}") for i, j in pairs if i <= j])
    cells = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("value")) for i, j in pairs])
    return one.select(F.inline(cells))


def corrcov(c: DataFrame) -> DataFrame:
    """Covariance rows (i, j, value) to correlation rows with sigma of i."""
    d = c.filter("i = j").select(F.col("i").alias("k"), F.sqrt("value").alias("s"))
    out = c.join(d.select(F.col("k").alias("i"), F.col("s").alias("si")), "i").join(d.select(F.col("k").alias("j"), F.col("s").alias("sj")), "j")
    return out.select("i", "j", (F.col("value") / (F.col("si") * F.col("sj"))).alias("value"), F.col("si").alias("sigma"))


# Histograms --------------------------------------------------------------------------------------


def bin_of(x, edges: Sequence[float], last_closed: bool = False) -> Column:
    """1-based bin of [e_k, e_k+1); a value equal to the last edge has bin len(edges), or the last bin with last_closed; 0 outside."""
    if any(math.isnan(e) for e in edges) or any(b < a for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges must be numbers in non-decreasing order")
    x, n = num(x), len(edges)
    at = F.array(*[F.lit(float(e)) for e in edges])
    k = F.size(F.filter(at, lambda e: e <= x))
    inside = (x >= float(edges[0])) & (x <= float(edges[-1])) & ~F.isnan(x)
    k = F.least(k, F.lit(n - 1)) if last_closed else k
    return F.when(inside, k).otherwise(0)


def histc(df: DataFrame, column: str, edges: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Counts of every bin, empty ones too; the last bin holds values equal to the last edge."""
    return _counted(df, bin_of(column, edges), len(edges), groups)


def histcounts(df: DataFrame, column: str, edges: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Like histc, with the last edge inside the last bin."""
    return _counted(df, bin_of(column, edges, True), len(edges) - 1, groups)


def _counted(df: DataFrame, k: Column, bins: int, groups: Sequence[str]) -> DataFrame:
    found = df.groupBy(*groups, k.alias("bin")).agg(F.count("*").alias("n")).filter("bin > 0")
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if groups:
        every = df.select(*groups).dropDuplicates().crossJoin(F.broadcast(every))  # as many rows as there are bins
    return every.join(found, [*groups, "bin"], "left").select(*groups, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def histcounts2(df: DataFrame, x: str, y: str, xedges: Sequence[float], yedges: Sequence[float]) -> DataFrame:
    """Counts of non-empty cells of a grid."""
    g = df.groupBy(bin_of(x, xedges, True).alias("xbin"), bin_of(y, yedges, True).alias("ybin")).agg(F.count("*").alias("count"))
    return g.filter("xbin > 0 and ybin > 0")


def polarhistogram(df: DataFrame, theta: str, bins: int) -> DataFrame:
    from tabulon.functions.elementwise import mod

    w = 2 * math.pi / bins
    k = F.least(F.floor(mod(theta, 2 * math.pi) / w), F.lit(bins - 1)).cast("int") + 1
    return _counted(df, F.when(F.isnan(num(theta)), 0).otherwise(k), bins, ())


def imhist(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """Counts of intensities in [0, 1]."""
    k = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), num(value))) * (bins - 1) + 0.5).cast("int") + 1
    return _counted(df, F.when(F.isnan(num(value)), 0).otherwise(k), bins, ())


def pie(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shares of a total."""
    g = df.groupBy(*keys).agg(reduce_(value, "sum").alias("v"))
    total = g.agg(F.sum("v").alias("t"))
    return g.crossJoin(F.broadcast(total)).select(*keys, (F.col("v") / F.col("t")).alias("share"))


def heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    return df.groupBy(x, y).agg(reduce_(value, "mean").alias("value"))


def boxplot(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    q = [quantile(column, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return df.groupBy(*groups).agg(*q, reduce_(column, "min").alias("lo"), reduce_(column, "max").alias("hi"))


def lsline(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """Least-squares line."""
    return df.groupBy(*groups).agg(F.regr_slope(num(y), num(x)).alias("slope"), F.regr_intercept(num(y), num(x)).alias("intercept"))


def qqplot(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """Sample quantiles beside standard normal ones."""
    from tabulon.functions.special import norminv

    ps = [(k - 0.5) / points for k in range(1, points + 1)]
    one = df.agg(F.percentile(_ok(num(column)), F.array(*[F.lit(p) for p in ps])).alias("q"))
    rows = one.select(F.posexplode("q").alias("k", "sample"))
    return rows.select("k", "sample", norminv((F.col("k") + 0.5) / points).alias("normal"))
