"""Files and tables: delimited text, Parquet, JSON, XML, lines, chunked datasets.

Readers are lazy DataFrames on Spark's own sources, so any Hadoop path works and columns and filters
reach the scan.  Sniffing looks at a bounded number of lines.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.elementwise import NAN
from tabulon.operators.table import valid_names

SNIFF_LINES = 32
DELIMITERS = [",", "\t", ";", "|"]
TRUE, FALSE = {"true", "t", "yes", "on"}, {"false", "f", "no", "off"}
_NUMBER = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf(?:inity)?)$|nan$", re.I)
_DATE = re.compile(r"\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d(?::\d\d(?:\.\d+)?)?)?$")


@dataclass
class ImportOptions:
    """How a delimited file is read."""

    delimiter: str = ","
    header: bool = True
    names: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    selected: list[str] = field(default_factory=list)
    missing: str = ""


def _split(line: str, sep: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=sep), [""]) if sep != " " else line.split()


def sniff_delimiter(lines: Sequence[str]) -> str:
    """The candidate with the highest mean number of fields (2 at least), else white space."""
    lines = [x for x in lines if x.strip()][:SNIFF_LINES]
    best, most = " ", 1.999
    for d in DELIMITERS:
        mean = sum(len(_split(x, d)) for x in lines) / max(1, len(lines))
        if mean > most:
            best, most = d, mean
    return best


def _class(cells: Sequence[str]) -> str:
    c = [x.strip() for x in cells if x.strip()]
    if not c or all(_NUMBER.match(x) for x in c):
        return "double"
    if all(x.lower() in TRUE | FALSE for x in c):
        return "logical"
    return "datetime" if all(_DATE.match(x) for x in c) else "string"


def detect_import_options(spark: SparkSession, path: str) -> ImportOptions:
    """Delimiter, header, names and type classes from the first lines."""
    lines = [r.value for r in spark.read.text(path).limit(SNIFF_LINES).collect()]
    sep = sniff_delimiter(lines)
    rows = [_split(x, sep) for x in lines if x.strip()]
    if not rows:
        return ImportOptions(sep, False)
    first = [x.strip() for x in rows[0]]
    header = not any(x == "" for x in first) and not all(_class([x]) != "string" for x in first)
    width = max(map(len, rows))
    names = valid_names(first + [f"Var{i + 1}" for i in range(len(first), width)] if header else [f"Var{i + 1}" for i in range(width)])
    body = rows[1:] if header else rows
    types = {n: _class([r[i] for r in body if i < len(r)]) for i, n in enumerate(names)}
    return ImportOptions(sep, header, names, types)


def readtable(spark: SparkSession, path: str, options: ImportOptions | None = None, **kw) -> DataFrame:
    """Delimited text as a table; cells that do not parse are missing."""
    o = options or detect_import_options(spark, path)
    for k, v in kw.items():
        setattr(o, k, v)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in o.names])
    raw = spark.read.schema(schema).option("sep", "\t" if o.delimiter == "\t" else o.delimiter).option("header", o.header).option("enforceSchema", True).option("nullValue", o.missing).csv(path)
    out = []
    for n in o.selected or o.names:
        c, kind = F.trim(F.col(n)), o.types.get(n, "string")
        if kind == "double":
            low = F.lower(c)
            v = F.when(low.isin("inf", "+inf", "infinity"), float("inf")).when(low.isin("-inf", "-infinity"), float("-inf")).otherwise(c.try_cast("double"))
            c = F.coalesce(v, F.lit(NAN))
        elif kind == "logical":
            c = F.lower(c).isin(list(TRUE))
        elif kind == "datetime":
            c = c.try_cast("timestamp_ntz")
        else:
            c = F.col(n)
        out.append(c.alias(n))
    return raw.select(*out)


def readtimetable(spark: SparkSession, path: str, time: str, options: ImportOptions | None = None) -> DataFrame:
    from tabulon.operators.table import timetable

    return timetable(readtable(spark, path, options), time)


def readmatrix(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as doubles; text is NaN."""
    o = detect_import_options(spark, path)
    o.delimiter = sep or o.delimiter
    o.types = dict.fromkeys(o.names, "double")
    return readtable(spark, path, o)


def csvread(spark: SparkSession, path: str) -> DataFrame:
    """Numeric text without header; blanks are 0."""
    o = detect_import_options(spark, path)
    o.header, o.delimiter = False, ","
    o.names = [f"Var{i + 1}" for i in range(len(o.names))]
    o.types = dict.fromkeys(o.names, "double")
    d = readtable(spark, path, o)
    return d.select(*[F.when(F.isnan(c), 0.0).otherwise(F.col(c)).alias(c) for c in d.columns])


def readcell(spark: SparkSession, path: str) -> DataFrame:
    o = detect_import_options(spark, path)
    o.types = {}
    d = readtable(spark, path, o)
    return d.select(F.array(*d.columns).alias("cells"))


def writetable(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "error") -> None:
    """A folder of delimited parts, written in parallel."""
    df.write.mode(mode).option("sep", sep).option("header", header).option("escape", '"').csv(path)


writetimetable = writematrix = csvwrite = writetable


def parquetread(spark: SparkSession, path: str, variables: Sequence[str] | None = None) -> DataFrame:
    """Parquet with numbers as doubles (NULL: NaN); only the selected columns are read."""
    d = spark.read.parquet(path)
    d = d.select(*variables) if variables else d
    bad = [f.name for f in d.schema if isinstance(f.dataType, (T.StructType, T.MapType))]
    if bad:
        raise TypeError(f"nested columns are not supported: {bad}")
    return d.select(*[F.coalesce(F.col(f.name).cast("double"), F.lit(NAN)).alias(f.name) if isinstance(f.dataType, T.NumericType) else F.col(f.name) for f in d.schema])


def parquetwrite(df: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def parquetinfo(spark: SparkSession, path: str) -> dict:
    """Schema, files and rows; the row count is answered from footers."""
    d = spark.read.parquet(path)
    return {"variables": d.columns, "types": [f.dataType.simpleString() for f in d.schema], "files": d.inputFiles(), "rows": d.count()}


def parquet_datastore(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def array_datastore(spark: SparkSession, rows: Sequence, schema: str, read_size: int = 1000) -> DataFrame:
    return spark.createDataFrame(rows, schema).repartition(max(1, -(-len(rows) // read_size)))


def file_datastore(spark: SparkSession, path: str, pattern: str = "*", read=None, schema: str | None = None) -> DataFrame:
    """Files with content; a pandas read function turns batches of (path, content) into rows."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return d.mapInPandas(lambda it: (read(p) for p in it), schema) if read else d


def readlines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def fileread(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def writelines(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).text(path)


def dir_(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and time of files; contents are not read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return d.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("date"))


def readjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def readstruct(spark: SparkSession, path: str, row: str = "row") -> DataFrame:
    """XML rows as structs."""
    return spark.read.format("xml").option("rowTag", row).load(path)


def xmlwrite(df: DataFrame, path: str, row: str = "row", mode: str = "error") -> None:
    df.write.mode(mode).format("xml").option("rowTag", row).save(path)


def extract_file_text(spark: SparkSession, path: str) -> DataFrame:
    from tabulon.operators.text import html_text

    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return d.select("path", F.when(F.col("path").rlike(r"\.html?$"), html_text("value")).otherwise(F.col("value")).alias("text"))


class Dataset:
    """A chunked N-D array as Parquet below a folder: (c1, ..., cn, i1, ..., in, v) and a manifest row of shape, chunk and version.

    Each write makes a data folder of its own and then one manifest row that names it; a writer that
    started from an older version fails, so commits are optimistic.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, shape: Sequence[int], chunk: Sequence[int]) -> Dataset:
        self._commit(0, {"shape": list(shape), "chunk": list(chunk)}, None)
        return self

    def _manifests(self) -> list[dict]:
        return [json.loads(r.value) for r in self.spark.read.text(f"{self.path}/manifest").collect()]

    def manifest(self) -> dict:
        return max(self._manifests(), key=lambda m: m["version"])

    def _commit(self, version: int, facts: dict, seen: int | None) -> None:
        if seen is not None and self.manifest()["version"] != seen:
            raise RuntimeError("the dataset changed since it was read")
        row = json.dumps({**facts, "version": version})
        # The folder of a version can be made once only, which settles races.
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("error").text(f"{self.path}/manifest/v={version}")

    def write(self, cells: DataFrame, seen: int | None = None) -> int:
        """Cells (i1, ..., in, v) replace or add to what is there."""
        m = self.manifest()
        seen = m["version"] if seen is None else seen
        n = len(m["shape"])
        own = cells
        for k in range(n):
            own = own.withColumn(f"c{k + 1}", F.floor((F.col(f"i{k + 1}") - 1) / m["chunk"][k]).cast("int"))
        if m["version"] != seen:
            raise RuntimeError("the dataset changed since it was read")
        version, folder = seen + 1, uuid.uuid4().hex
        own.withColumn("version", F.lit(version)).write.mode("error").partitionBy(*[f"c{k + 1}" for k in range(n)]).parquet(f"{self.path}/data/{folder}")
        self._commit(version, {"shape": m["shape"], "chunk": m["chunk"], "folder": folder}, seen)
        return version

    def read(self, *slices: tuple[int, int]) -> DataFrame:
        """Cells in 1-based inclusive ranges of every dimension; chunks outside are pruned by partition."""
        m = self.manifest()
        n = len(m["shape"])
        keys = [f"i{k + 1}" for k in range(n)]
        paths = [f"{self.path}/data/{x['folder']}" for x in self._manifests() if "folder" in x]
        if not paths:
            return self.spark.createDataFrame([], ", ".join(f"{k} long" for k in keys) + ", v double")
        parts = []
        for p in paths:
            d = self.spark.read.parquet(p)
            for k, (a, b) in enumerate(slices):
                c = m["chunk"][k]
                d = d.filter(F.col(f"c{k + 1}").between((a - 1) // c, (b - 1) // c) & F.col(keys[k]).between(a, b))
            parts.append(d.select(*keys, "v", "version"))
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        return u.groupBy(*keys).agg(F.max_by("v", "version").alias("v"))
