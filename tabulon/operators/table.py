"""Tables and timetables on DataFrames: construction, metadata, selectors, conversion.

Row order is part of a table, so every order-sensitive call takes the columns that give it.
Facts about the whole table (row times, units, categories) travel in column metadata.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.elementwise import NAN, num


def valid_names(names: Sequence[str]) -> list[str]:
    """Valid and unique variable names."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"\W+", "_", n.strip()) or "Var"
        base = base if re.match(r"[A-Za-z]", base) else f"x{base}"
        name, k = base, 0
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def table(spark: SparkSession, columns: dict[str, Sequence], row_names: Sequence[str] | None = None) -> DataFrame:
    """A table of equal-height columns."""
    heights = {len(v) for v in columns.values()} | ({len(row_names)} if row_names else set())
    if len(heights) > 1:
        raise ValueError("all variables must have the same number of rows")
    names = valid_names(list(columns))
    if row_names:
        columns, names = {"Row": row_names, **columns}, ["Row", *names]
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, names) if rows else spark.createDataFrame([], T.StructType([T.StructField(n, T.DoubleType()) for n in names]))


def with_metadata(df: DataFrame, column: str, **facts) -> DataFrame:
    return df.withMetadata(column, {**df.schema[column].metadata, **facts})


def units(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata.get("units", "") for f in df.schema}


def timetable(df: DataFrame, time_column: str) -> DataFrame:
    """Marks the column of row times, which comes first."""
    kind = df.schema[time_column].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DayTimeIntervalType, T.DoubleType)):
        raise TypeError(f"{time_column} is {kind.simpleString()}: row times are dates, times or durations")
    out = df.select(time_column, *[c for c in df.columns if c != time_column])
    return with_metadata(out, time_column, row_times=True)


table2timetable = timetable


def row_times(df: DataFrame) -> str | None:
    return next((f.name for f in df.schema if f.metadata.get("row_times")), None)


def timetable2table(df: DataFrame, name: str = "Time") -> DataFrame:
    t = row_times(df)
    out = df.withColumnRenamed(t, name)
    return out.withMetadata(name, {k: v for k, v in df.schema[t].metadata.items() if k != "row_times"})


def array2table(df: DataFrame, array: str, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """An array column as one variable for each name."""
    return df.select(*keys, *[F.get(array, F.lit(i)).alias(n) for i, n in enumerate(valid_names(names))])


def array2timetable(df: DataFrame, array: str, names: Sequence[str], time_column: str) -> DataFrame:
    return timetable(array2table(df, array, names, [time_column]), time_column)


def table2array(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.array(*[num(v) for v in variables]).alias("value"))


def table2cell(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.array(*[F.col(c).cast("string") for c in df.columns if c not in keys]).alias("cells"))


def table2struct(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias("s"))


def struct2table(df: DataFrame, struct: str = "s", keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, f"{struct}.*")


def cell2table(spark: SparkSession, cells: Sequence[Sequence], names: Sequence[str] | None = None) -> DataFrame:
    width = len(cells[0]) if cells else 0
    return spark.createDataFrame([tuple(r) for r in cells], valid_names(names or [f"Var{i + 1}" for i in range(width)]))


def cell2struct(values: Sequence, fields: Sequence[str]) -> Column:
    return F.struct(*[F.lit(v).alias(f) for v, f in zip(values, fields, strict=True)])


# Facts -------------------------------------------------------------------------------------------


def height(df: DataFrame) -> int:
    return df.count()


def width(df: DataFrame) -> int:
    return len(df.columns)


def size(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def numel(df: DataFrame) -> int:
    return df.count() * len(df.columns)


def istable(x) -> bool:
    return isinstance(x, DataFrame)


def istimetable(x) -> bool:
    return isinstance(x, DataFrame) and row_times(x) is not None


def isempty(df: DataFrame) -> bool:
    return not df.columns or df.isEmpty()


def isnumeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def islogical(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.BooleanType)


def iscategorical(df: DataFrame, c: str) -> bool:
    return "categories" in df.schema[c].metadata


def isordinal(df: DataFrame, c: str) -> bool:
    return bool(df.schema[c].metadata.get("ordinal"))


def class_of(df: DataFrame, c: str) -> str:
    """The class name of a variable."""
    kind = df.schema[c].dataType
    if iscategorical(df, c):
        return "categorical"
    names = {T.DoubleType: "double", T.FloatType: "single", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.DecimalType: "double", T.BooleanType: "logical", T.StringType: "string"}
    names |= {T.CharType: "char", T.VarcharType: "char", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DateType: "datetime", T.DayTimeIntervalType: "duration", T.StructType: "struct", T.MapType: "dictionary", T.ArrayType: "cell", T.BinaryType: "uint8"}
    return next((v for k, v in names.items() if type(kind) is k), kind.simpleString())


def isa(df: DataFrame, c: str, kind: str) -> bool:
    """Whether a variable has a class, or belongs to numeric, float or integer."""
    name = class_of(df, c)
    return {"numeric": isnumeric(df, c), "float": name in ("double", "single"), "integer": "int" in name}.get(kind, name == kind)


def ischar(df: DataFrame, c: str) -> bool:
    return class_of(df, c) == "char"


def isstring(df: DataFrame, c: str) -> bool:
    return class_of(df, c) == "string"


def iscell(df: DataFrame, c: str) -> bool:
    return class_of(df, c) == "cell"


def iscellstr(df: DataFrame, c: str) -> bool:
    return iscell(df, c) and isinstance(df.schema[c].dataType.elementType, T.StringType)


def isreal(df: DataFrame, c: str) -> bool:
    """Numbers, truth values and text are real; complex values are structs here."""
    return isnumeric(df, c) or islogical(df, c) or isstring(df, c) or ischar(df, c)


def fieldnames(df: DataFrame) -> list[str]:
    return df.columns


def isfield(df: DataFrame, *names: str) -> list[bool]:
    return [n in df.columns for n in names]


def orderfields(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    return df.select(*(order or sorted(df.columns)))


def rmfield(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no such field: {missing}")
    return df.drop(*names)


def structfun(f, df: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *[f(F.col(x)).alias(x) for x in fields])


# Selectors ---------------------------------------------------------------------------------------

_KINDS = {
    "numeric": T.NumericType, "double": T.DoubleType, "single": T.FloatType, "int32": T.IntegerType, "int64": T.LongType, "logical": T.BooleanType, "string": T.StringType,
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType), "duration": T.DayTimeIntervalType, "cell": T.ArrayType, "struct": T.StructType,
}


def vartype(df: DataFrame, kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """Variables of a type class."""
    if kind == "categorical":
        return df.select(*keys, *[c for c in df.columns if iscategorical(df, c) and c not in keys])
    return df.select(*keys, *[f.name for f in df.schema if isinstance(f.dataType, _KINDS[kind]) and f.name not in keys])


def timerange(df: DataFrame, time: str, start=None, end=None, closed: str = "openright") -> DataFrame:
    """Rows in an interval: openright, openleft, open or closed; either bound may be None."""
    t, keep = F.col(time), F.col(time).isNotNull()
    kind = df.schema[time].dataType
    if start is not None:
        a = F.lit(start).cast(kind)
        keep = keep & (t >= a if closed in ("openright", "closed") else t > a)
    if end is not None:
        b = F.lit(end).cast(kind)
        keep = keep & (t <= b if closed in ("openleft", "closed") else t < b)
    return df.filter(keep)


def rowfilter(df: DataFrame, predicate: str | Column, variables: Sequence[str] = ()) -> DataFrame:
    """Rows where a named predicate holds for all listed variables (none listed: no rows), or a mask is true."""
    if isinstance(predicate, Column):
        return df.filter(predicate)
    alias = {">0": "gt0", "positive": "gt0", ">=0": "ge0", "nonnegative": "ge0", "<0": "lt0", "negative": "lt0", "notmissing": "nonmissing"}
    tests = {"gt0": lambda c: (num(c) > 0) & ~F.isnan(num(c)), "ge0": lambda c: (num(c) >= 0) & ~F.isnan(num(c)), "lt0": lambda c: num(c) < 0, "nonmissing": lambda c: ~ismissing(df, c)}
    test = tests[alias.get(predicate, predicate)]
    return df.filter(reduce(lambda a, b: a & b, map(test, variables))) if variables else df.limit(0)


def head(df: DataFrame, order: Sequence[str], k: int = 8) -> DataFrame:
    return df.orderBy(*order).limit(k)


def tail(df: DataFrame, order: Sequence[str], k: int = 8) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(k)


def subsref(df: DataFrame, rows: Column | None = None, variables: Sequence[str] | None = None, brace: bool = False) -> DataFrame:
    """T(rows, vars), or T{rows, vars} with brace."""
    out = df if rows is None else df.filter(rows)
    out = out if variables is None else out.select(*variables)
    return table2array(out, out.columns) if brace else out


def subsasgn(df: DataFrame, variable: str, value: Column, rows: Column | None = None) -> DataFrame:
    """Assigns a variable, or a row block of one; a new variable is missing elsewhere."""
    if rows is None:
        return df.withColumn(variable, value)
    old = F.col(variable) if variable in df.columns else F.lit(None)
    return df.withColumn(variable, F.when(rows, value).otherwise(old))


def rows_by_key(df: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """Rows of the wanted keys in that order; an error if one is not there."""
    kind = df.schema[key].dataType.simpleString()
    want = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(wanted)], f"selector int, {key} {kind}")
    lost = want.join(df.select(key).dropDuplicates(), key, "left_anti").limit(1).collect()
    if lost:
        raise KeyError(f"no row {lost[0][key]!r}")
    return df.join(F.broadcast(want), key).select("selector", *df.columns)  # the list is the caller's


# Missing -----------------------------------------------------------------------------------------


def ismissing(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    x = F.col(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull() | (x == "") if isinstance(kind, T.StringType) else x.isNull()


def anymissing(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return df.agg(*[F.coalesce(F.bool_or(ismissing(df, c)), F.lit(False)).alias(c) for c in variables])


def rmmissing(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return df.filter(~reduce(lambda a, b: a | b, [ismissing(df, c) for c in variables]))


def fill_constant(df: DataFrame, value, variables: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(ismissing(df, c), F.lit(value)).otherwise(F.col(c)) for c in variables})


def standardize_missing(df: DataFrame, indicators: Sequence, variables: Sequence[str]) -> DataFrame:
    """Listed values become missing."""
    none = lambda c: F.lit(NAN) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.lit(None)
    return df.withColumns({c: F.when(F.col(c).isin(list(indicators)), none(c)).otherwise(F.col(c)) for c in variables})


# Categories and dictionaries ---------------------------------------------------------------------


def categorical(df: DataFrame, column: str, categories: Sequence[str], ordinal: bool = False, code: str = "code") -> DataFrame:
    """Adds 1-based codes of a label column; NaN for labels outside the categories, which must be distinct."""
    if len(set(categories)) != len(categories):
        raise ValueError("categories must be distinct")
    m = F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(float(i + 1)))]) if categories else F.lit(None).cast("map<string,double>")
    out = df.withColumn(code, F.coalesce(m[F.col(column)], F.lit(NAN)))
    return with_metadata(out, column, categories=list(categories), ordinal=ordinal)


def ordinal_compare(df: DataFrame, column: str, op: str, label: str, code: str = "code") -> Column:
    """Order comparison with a category; undefined labels compare false. Only for ordinal columns."""
    facts = df.schema[column].metadata
    if op not in ("==", "~=") and not facts.get("ordinal"):
        raise TypeError("order comparison needs an ordinal column")
    k, c = float(facts["categories"].index(label) + 1), F.col(code)
    body = {"<": c < k, "<=": c <= k, ">": c > k, ">=": c >= k, "==": c == k, "~=": c != k}[op]
    return body & ~F.isnan(c) if op != "~=" else body | F.isnan(c)


def dictionary(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def lookup(d: Column, key: Column) -> Column:
    """Value of a key; an error if it is absent."""
    return F.when(F.map_contains_key(d, key), d[key]).otherwise(F.raise_error(F.concat(F.lit("no such key: "), key.cast("string"))))


def dict_keys(d: Column) -> Column:
    return F.map_keys(d)


def dict_values(d: Column) -> Column:
    return F.map_values(d)


def dict_put(d: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(d, lambda k, _: k != key), F.create_map(key, value))


def dict_remove(d: Column, key: Column) -> Column:
    return F.map_filter(d, lambda k, _: k != key)


# Concatenation -----------------------------------------------------------------------------------


def vertcat(*tables: DataFrame) -> DataFrame:
    """Rows one below the other; `part` tells the operand and so keeps the order."""
    return reduce(lambda a, b: a.unionByName(b), [t.withColumn("part", F.lit(i)) for i, t in enumerate(tables)])


def horzcat(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Columns side by side by a row key."""
    return a.join(b, list(on))


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """1-based row numbers over an order.

    Rows are range-partitioned, numbered within their partition, and partition offsets (one row for
    each) are added, so no task sees all rows.
    """
    from tabulon.operators.windows import spread

    s = spread(df, order)
    inside = Window.partitionBy("__p").orderBy(*order)
    s = s.withColumn(name, F.row_number().over(inside).cast("long"))
    ahead = s.groupBy("__p").agg(F.count("*").alias("__n"))
    ahead = ahead.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__a"))
    return s.join(F.broadcast(ahead), "__p").withColumn(name, F.col(name) + F.col("__a")).drop("__p", "__a")
