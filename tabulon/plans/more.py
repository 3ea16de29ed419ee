"""Queries for files, facts about variables, vocabularies and small solves, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import linalg as la
from tabulon.operators import table as t
from tabulon.operators import text as tx
from tabulon.operators import windows as w
from tabulon.plans.tables import read, rounded
from tabulon.sources import io

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; a temporary one in local mode where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tabulon-files-')}"
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


def rows_of(spark: SparkSession, facts: dict) -> DataFrame:
    return spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in facts.items()], "fact string, value string")


def facts_sql(facts: dict) -> str:
    return " union all ".join(f"select '{k}' as fact, '{v}' as value" for k, v in facts.items())


# Files -------------------------------------------------------------------------------------------


def _customers(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").cast("double").alias("c_custkey"), "c_name", "c_acctbal", "c_mktsegment")


_CUSTOMERS = "select c_custkey::double as c_custkey, c_name, c_acctbal, c_mktsegment from customer"


@query("f_writetable_readtable", _CUSTOMERS)
def writetable_readtable(spark, sf):
    path = scratch(spark)
    io.writetable(_customers(spark, sf), path)
    return io.readtable(spark, path)


@query("f_detect_import_options", facts_sql({"delimiter": ";", "header": "true", "c_custkey": "double", "c_name": "string", "c_acctbal": "double", "c_mktsegment": "string"}))
def detect_import_options(spark, sf):
    path = scratch(spark)
    io.writetable(_customers(spark, sf), path, sep=";")
    o = io.detect_import_options(spark, path)
    return rows_of(spark, {"delimiter": o.delimiter, "header": o.header, **o.types})


@query("f_readtimetable", "select o_orderdate as Time, o_orderkey::double as o_orderkey, o_totalprice from orders")
def readtimetable(spark, sf):
    path = scratch(spark)
    rows = read(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderkey", "o_totalprice")
    io.writetimetable(rows, path)
    return t.timetable2table(io.readtimetable(spark, path, "o_orderdate"), "Time").select("Time", "o_orderkey", "o_totalprice")


@query("f_writematrix_readmatrix", "select p_size::double as Var1, p_retailprice as Var2 from part")
def writematrix_readmatrix(spark, sf):
    path = scratch(spark)
    io.writematrix(read(spark, sf, "part").select("p_size", "p_retailprice"), path, header=False)
    return io.readmatrix(spark, path)


@query("f_csvwrite_csvread", "select p_size::double as Var1, p_retailprice as Var2 from part")
def csvwrite_csvread(spark, sf):
    path = scratch(spark)
    io.csvwrite(read(spark, sf, "part").select("p_size", "p_retailprice"), path, header=False)
    return io.csvread(spark, path)


@query("f_readcell", "select c_custkey::varchar as key, c_name as name from customer")
def readcell(spark, sf):
    path = scratch(spark)
    io.writetable(read(spark, sf, "customer").select("c_custkey", "c_name"), path)
    return io.readcell(spark, path).select(F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("name"))


@query("f_writelines_readlines", "select c_name as line from customer")
def writelines_readlines(spark, sf):
    path = scratch(spark)
    io.writelines(read(spark, sf, "customer").select(F.col("c_name").alias("value")), path)
    return io.readlines(spark, path).toDF("line")


@query("f_parquet_datastore", "select o_orderstatus, count(*) as n from (select o_orderstatus from orders union all select o_orderstatus from orders) group by 1")
def parquet_datastore(spark, sf):
    return io.parquet_datastore(spark, f"{sf}/orders.parquet", f"{sf}/orders.parquet").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("f_array_datastore", "select * from (values (1.0::double, 'a'), (2.0, 'b'), (3.0, 'c')) v(x, s)")
def array_datastore(spark, sf):
    return io.array_datastore(spark, [(1.0, "a"), (2.0, "b"), (3.0, "c")], "x double, s string", 2)


# Facts -------------------------------------------------------------------------------------------

_TYPES = {"c_custkey": "int64", "c_name": "string", "c_nationkey": "int32", "c_acctbal": "double", "c_mktsegment": "string"}


@query("t_class", facts_sql(_TYPES))
def class_(spark, sf):
    d = read(spark, sf, "customer")
    return rows_of(spark, {c: t.class_of(d, c) for c in d.columns})


@query("t_isa", facts_sql({"numeric": "true", "float": "true", "integer": "false", "double": "true", "string": "false", "isstring": "true", "ischar": "false", "isreal": "true", "isnumeric": "true", "islogical": "false", "iscell": "true", "iscellstr": "false"}))
def isa(spark, sf):
    d, e = read(spark, sf, "customer"), read(spark, sf, "embeddings")
    facts = {k: t.isa(d, "c_acctbal", k) for k in ("numeric", "float", "integer", "double", "string")}
    facts |= {"isstring": t.isstring(d, "c_name"), "ischar": t.ischar(d, "c_name"), "isreal": t.isreal(d, "c_acctbal"), "isnumeric": t.isnumeric(d, "c_acctbal"), "islogical": t.islogical(d, "c_acctbal")}
    return rows_of(spark, facts | {"iscell": t.iscell(e, "embedding"), "iscellstr": t.iscellstr(e, "embedding")})


@query("t_istable", facts_sql({"istable": "true", "istimetable": "false", "istimetable of timetable": "true", "iscategorical": "true", "isordinal": "true", "iscategorical of text": "false"}))
def istable(spark, sf):
    d = read(spark, sf, "orders")
    c = t.categorical(d, "o_orderstatus", ["F", "O", "P"], ordinal=True)
    tt = t.timetable(d, "o_orderdate")
    return rows_of(spark, {"istable": t.istable(d), "istimetable": t.istimetable(d), "istimetable of timetable": t.istimetable(tt), "iscategorical": t.iscategorical(c, "o_orderstatus"), "isordinal": t.isordinal(c, "o_orderstatus"), "iscategorical of text": t.iscategorical(c, "o_orderpriority")})


@query("t_fieldnames", "select unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']) as field, unnest([true, true, true, true]) as known union all select 'none', false")
def fieldnames(spark, sf):
    d = read(spark, sf, "supplier")
    names = [*t.fieldnames(d), "none"]
    return spark.createDataFrame(list(zip(names, t.isfield(d, *names), strict=True)), "field string, known boolean")


@query("t_cell2table", "select * from (values (1::bigint, 'x'), (2, 'y')) v(Var1, Var2)")
def cell2table(spark, sf):
    return t.cell2table(spark, [[1, "x"], [2, "y"]])


@query("t_cell2struct", "select s_suppkey, 7 as a, 'seven' as b from supplier")
def cell2struct(spark, sf):
    d = read(spark, sf, "supplier").withColumn("s", t.cell2struct([7, "seven"], ["a", "b"]))
    return d.select("s_suppkey", "s.a", "s.b")


@query("t_array2timetable", "select o_orderdate as Time, o_totalprice as price, o_custkey::double as customer from orders")
def array2timetable(spark, sf):
    d = read(spark, sf, "orders").select("o_orderdate", F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double")).alias("v"))
    return t.timetable2table(t.array2timetable(d, "v", ["price", "customer"], "o_orderdate"), "Time").select("Time", "price", "customer")


# Words -------------------------------------------------------------------------------------------

_WORD = "(select item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}]+)*')) as word from benchmark)"


def _bench(spark, sf):
    d = read(spark, sf, "benchmark")
    return d, tx.vocabulary(d, "item_id", "text")


@query("x_is_vocabulary_word", f"select p_partkey, coalesce(p_type, '') in (select word from {_WORD}) as known from part")
def is_vocabulary_word(spark, sf):
    return tx.is_vocabulary_word(read(spark, sf, "part").select("p_partkey", F.coalesce("p_type", F.lit("")).alias("word")), "word", _bench(spark, sf)[1]).select("p_partkey", "known")


@query("x_ind2word", f"select word, count(*) as n from {_WORD} group by 1")
def ind2word(spark, sf):
    d, v = _bench(spark, sf)
    return tx.ind2word(v.select("index", F.col("count").alias("n")), "index", v.select("word", "index")).select("word", "n")


@query("x_encode", f"select item_id, word, count(*) as count from {_WORD} group by 1, 2")
def encode(spark, sf):
    d, v = _bench(spark, sf)
    return tx.ind2word(tx.encode(d, "item_id", "text", v), "index", v.select("word", "index")).select("item_id", "word", "count")


# Solves on a small matrix of sums ----------------------------------------------------------------

#: [[a, b], [b, c]] from the sizes of all parts, scaled by their number.
_A = "(select 1.0::double as a, avg(p_size::double) as b, avg(p_size::double * p_size) as c, avg(p_retailprice) / 1000 as u, avg(p_retailprice * p_size) / 1000 as v from part)"


def _normal(spark, sf) -> tuple[np.ndarray, np.ndarray]:
    d = read(spark, sf, "part").select(F.lit(1.0).alias("one"), "p_size", "p_retailprice")
    g, r, _, n = la.gram(d, ["one", "p_size"], "p_retailprice")
    return g / n, (r / n / 1000).reshape(2, 1)


def _entries(spark, **parts) -> DataFrame:
    out = []
    for k, m in parts.items():
        m = np.atleast_2d(np.asarray(m, dtype=float))
        out += [(k, i + 1, j + 1, round(float(m[i, j]), 6) + 0.0) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(out, "part string, i int, j int, v double")


def _cells(**cells: str) -> str:
    rows = [f"select '{k[:-2]}' as part, {k[-2]} as i, {k[-1]} as j, round({e}, 6) + 0.0 as v from {_A}" for k, e in cells.items()]
    return " union all ".join(rows)


_DET = "(a * c - b * b)"


@query("l_mldivide", _cells(x11=f"(u * c - v * b) / {_DET}", x21=f"(v * a - u * b) / {_DET}"))
def mldivide(spark, sf):
    m, y = _normal(spark, sf)
    return _entries(spark, x=la.SMALL["mldivide"](m, y))


@query("l_mrdivide", _cells(x11=f"(u * c - v * b) / {_DET}", x12=f"(v * a - u * b) / {_DET}"))
def mrdivide(spark, sf):
    m, y = _normal(spark, sf)
    return _entries(spark, x=la.SMALL["mrdivide"](y.T, m))


@query("l_det", _cells(det11=_DET))
def det(spark, sf):
    return _entries(spark, det=la.SMALL["det"](_normal(spark, sf)[0]))


_INV = {"inv11": f"c / {_DET}", "inv12": f"-b / {_DET}", "inv21": f"-b / {_DET}", "inv22": f"a / {_DET}"}


@query("l_inv", _cells(**_INV))
def inv(spark, sf):
    return _entries(spark, inv=la.SMALL["inv"](_normal(spark, sf)[0]))


@query("l_pinv", _cells(**_INV))
def pinv(spark, sf):
    return _entries(spark, inv=la.SMALL["pinv"](_normal(spark, sf)[0]))


@query("l_chol", _cells(r11="sqrt(a)", r12="b / sqrt(a)", r21="0.0", r22="sqrt(c - b * b / a)"))
def chol(spark, sf):
    return _entries(spark, r=la.SMALL["chol"](_normal(spark, sf)[0]))


@query("l_lu", _cells(l11="1.0", l12="0.0", l21="a / b", l22="1.0", u11="b", u12="c", u21="0.0", u22="b - a / b * c", p11="0.0", p12="1.0", p21="1.0", p22="0.0"))
def lu(spark, sf):
    low, up, perm = la.SMALL["lu"](_normal(spark, sf)[0])
    return _entries(spark, l=low, u=up, p=perm)


@query("l_rank_rref", _cells(rank11="2.0", rref11="1.0", rref12="0.0", rref21="0.0", rref22="1.0"))
def rank_rref(spark, sf):
    m = _normal(spark, sf)[0]
    return _entries(spark, rank=la.SMALL["rank"](m), rref=la.SMALL["rref"](m))


@query("l_cond", f"select 'cond' as part, 1 as i, 1 as j, round(((a + c) + sqrt((a - c) * (a - c) + 4 * b * b)) / ((a + c) - sqrt((a - c) * (a - c) + 4 * b * b)) / 1000, 4) + 0.0 as v from {_A}")
def cond(spark, sf):
    return _entries(spark, cond=la.SMALL["cond"](_normal(spark, sf)[0]) / 1000).withColumn("v", F.round("v", 4) + 0.0)


@query("l_rcond", _cells(rcond11=f"{_DET} / ((b + c) * (b + c))"))
def rcond(spark, sf):
    return _entries(spark, rcond=la.SMALL["rcond"](_normal(spark, sf)[0]))


@query("w_interp1_extrapolate", """with p as (select p_size::double as x, max(p_retailprice) as y from part where p_size between 10 and 40 group by 1), q as (select p_partkey, p_size::double as x from part),
  e as (select min(x) as x0, min(x) filter (x > (select min(x) from p)) as x1, max(x) filter (x < (select max(x) from p)) as x2, max(x) as x3 from p)
  select q.p_partkey, round(l.y + (r.y - l.y) * (q.x - l.x) / (r.x - l.x), 6) + 0.0 as y from q, e
  join p l on l.x = case when q.x < e.x1 then e.x0 when q.x >= e.x2 then e.x2 else (select max(x) from p where p.x <= q.x) end
  join p r on r.x = case when q.x < e.x1 then e.x1 when q.x >= e.x2 then e.x3 else (select min(x) from p where p.x > q.x) end""")
def interp1_extrapolate(spark, sf):
    d = read(spark, sf, "part")
    points = d.filter("p_size between 10 and 40").groupBy("p_size").agg(F.max("p_retailprice").alias("y"))
    at = w.interp1(points, d.select("p_size").distinct(), "p_size", "y", "p_size", extrapolate=True)
    return rounded(d.select("p_partkey", F.col("p_size").cast("double").alias("p_size")).join(at, "p_size").select("p_partkey", "y"), 6)
