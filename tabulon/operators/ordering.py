"""Sorting, top-k, set operators and approximate membership."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.elementwise import INF, num
from tabulon.operators.table import number_rows


def _key(c: str) -> Column:
    """"-x" sorts by x descending; missing is last ascending, first descending."""
    return F.col(c[1:]).desc_nulls_first() if c.startswith("-") else F.col(c).asc_nulls_last()


def sortrows(df: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*[_key(k) for k in (*keys, *tie)])


def argsort(df: DataFrame, column: str, row: Sequence[str], groups: Sequence[str] = (), descend: bool = False, magnitude: bool = False, name: str = "place") -> DataFrame:
    """Adds the 1-based place of each row in a stable sort; NaN last ascending and first descending."""
    x = F.abs(num(column)) if magnitude else num(column)
    if groups:
        w = Window.partitionBy(*groups).orderBy(x.desc() if descend else x.asc(), *row)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    if descend:
        out = number_rows(df.withColumn("__k", F.when(F.isnan(x), F.lit(-INF)).otherwise(-x)).withColumn("__n", F.when(F.isnan(x), 0).otherwise(1)), ["__n", "__k", *row], name)
        return out.drop("__k", "__n")
    return number_rows(df.withColumn("__k", x), ["__k", *row], name).drop("__k")


def issortedrows(df: DataFrame, keys: Sequence[str], row: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Whether rows, in row order, are sorted by keys, in each group."""
    w = Window.partitionBy(*groups).orderBy(*row)
    k = F.struct(*keys)
    return df.withColumn("__ok", F.coalesce(F.lag(k).over(w) <= k, F.lit(True))).groupBy(*groups).agg(F.bool_and("__ok").alias("sorted"))


def issorted(df: DataFrame, column: str, row: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    return issortedrows(df, [column], row, groups)


def maxk(df: DataFrame, column: str, k: int, row: Sequence[str], groups: Sequence[str] = (), name: str = "place") -> DataFrame:
    """The k largest of each group; NaN is greatest, ties by row.  Planned with a group limit before the shuffle."""
    return _topk(df, num(column).desc(), k, row, groups, name)


def mink(df: DataFrame, column: str, k: int, row: Sequence[str], groups: Sequence[str] = (), name: str = "place") -> DataFrame:
    return _topk(df, num(column).asc(), k, row, groups, name)


def _topk(df: DataFrame, key: Column, k: int, row: Sequence[str], groups: Sequence[str], name: str) -> DataFrame:
    if not groups:
        df = df.orderBy(key, *row).limit(k)  # a bounded top-k, then numbered
    w = Window.partitionBy(*groups).orderBy(key, *row)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def unique(df: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Distinct values, first row and number of occurrences."""
    return df.groupBy(*keys).agg(F.min(F.struct(*row)).alias("first"), F.count("*").alias("count")).select(*keys, "first.*", "count")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def setdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def setxor(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(*a.columns)
    tagged = a.withColumn("__s", F.lit(1)).unionByName(b.withColumn("__s", F.lit(2)))
    return tagged.groupBy(*a.columns).agg(F.bit_or("__s").alias("__s")).filter("__s < 3").drop("__s")


def ismember(a: DataFrame, b: DataFrame, keys: Sequence[str], row: Sequence[str] = (), name: str = "member") -> DataFrame:
    """Adds a mask, and with `row` also `locb`, the least row of b that matches. NaN and missing match nothing."""
    first = b.filter(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.min(F.struct(*row) if row else F.lit(1)).alias("locb"))
    out = a.join(first, list(keys), "left").withColumn(name, F.col("locb").isNotNull())
    return out if row else out.drop("locb")


def ismembertol(a: DataFrame, b: DataFrame, x: str, y: str, tol: float = 1e-12, row: str | None = None) -> DataFrame:
    """Adds `member` (and `locb`, the least row of b) for values within tol times the largest magnitude of both sides.

    A band join: both sides are cut into cells as wide as the threshold, b meets the three cells around
    it by equality, and the distance is then tested.  NaN matches nothing; equal values always do.
    """
    top = a.agg(F.max(F.when(~F.isnan(num(x)), F.abs(num(x)))).alias("m")).unionByName(b.agg(F.max(F.when(~F.isnan(num(y)), F.abs(num(y)))).alias("m"))).agg(F.max("m")).first()[0]
    t = tol * (top or 0.0)
    cell = (lambda v: F.floor(v / t)) if t > 0 and t < INF else (lambda v: F.xxhash64(v))
    u, v = num(x), num(y)
    loc = F.col(row) if row else F.lit(1)
    right = b.filter(~F.isnan(v)).groupBy(v.alias("__v")).agg(F.min(loc).alias("__r"))
    right = right.withColumn("__c", F.explode(F.array(*[cell(F.col("__v")) + d for d in ((-1, 0, 1) if 0 < t < INF else (0,))])))
    left = a.filter(~F.isnan(u)).select(u.alias("__u")).dropDuplicates().withColumn("__c", cell(F.col("__u")))
    met = left.join(right, "__c").filter((F.abs(F.col("__u") - F.col("__v")) <= t) | (F.col("__u") == F.col("__v"))).groupBy("__u").agg(F.min("__r").alias("locb"))
    out = a.join(met, u == F.col("__u"), "left").drop("__u").withColumn("member", F.col("locb").isNotNull())
    return out if row else out.drop("locb")


def combvec(a: DataFrame, b: DataFrame) -> DataFrame:
    """All combinations of rows."""
    return a.crossJoin(b)


def isequaln(a: DataFrame, b: DataFrame) -> bool:
    """Same columns and the same rows as often; NaN equals NaN."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def isequal(a: DataFrame, b: DataFrame) -> bool:
    """Like isequaln, but a NaN anywhere makes unequal."""
    spoiled = [F.isnan(F.col(f.name)) for f in a.schema if f.dataType.simpleString() in ("double", "float")]
    return isequaln(a, b) and not (spoiled and not a.filter(reduce(lambda x, y: x | y, spoiled)).isEmpty())


# Plain relational joins, offered for convenience ---------------------------------------------------


def innerjoin(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys), "inner")


def outerjoin(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "full") -> DataFrame:
    return a.join(b, list(keys), how)
