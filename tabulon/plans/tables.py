"""Queries for table operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import strings as st
from tabulon.operators import grouping as g
from tabulon.operators import linalg as la
from tabulon.operators import ordering as o
from tabulon.operators import signal as sg
from tabulon.operators import stats as ss
from tabulon.operators import table as t
from tabulon.operators import text as tx
from tabulon.operators import windows as w
from tabulon.sources import io
from tabulon.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# Sources and selectors ---------------------------------------------------------------------------


@query("q_pricing_summary", """select l_returnflag, l_linestatus, count(*) as GroupCount, round(sum(l_quantity), 2) + 0.0 as sum_l_quantity, round(sum(l_extendedprice), 2) + 0.0 as sum_l_extendedprice,
  round(avg(l_quantity), 2) + 0.0 as mean_l_quantity, round(avg(l_extendedprice), 2) + 0.0 as mean_l_extendedprice from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, sf):
    d = io.parquetread(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate"])
    d = t.timerange(d, "l_shipdate", None, "1998-09-02", "closed")
    return rounded(g.groupsummary(d, ["l_returnflag", "l_linestatus"], ["sum", "mean"], ["l_quantity", "l_extendedprice"]), 2)


@query("t_parquetread", "select c_custkey::double as c_custkey, c_name, c_acctbal from customer")
def parquetread(spark, sf):
    return io.parquetread(spark, f"{sf}/customer.parquet", ["c_custkey", "c_name", "c_acctbal"])


@query("t_parquetinfo", "select 'rows' as fact, count(*)::varchar as value from supplier union all select 'width', '4'")
def parquetinfo(spark, sf):
    i = io.parquetinfo(spark, f"{sf}/supplier.parquet")
    return spark.createDataFrame([("rows", str(i["rows"])), ("width", str(len(i["variables"])))], "fact string, value string")


@query("t_timerange_open", "select o_orderkey from orders where o_orderdate > timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'")
def timerange_open(spark, sf):
    return t.timerange(read(spark, sf, "orders"), "o_orderdate", "1995-01-01", "1996-01-01", "open").select("o_orderkey")


@query("t_vartype", "select p_partkey, p_name, p_brand, p_type from part")
def vartype(spark, sf):
    return t.vartype(read(spark, sf, "part"), "string", ["p_partkey"])


@query("t_rowfilter", "select c_custkey, c_acctbal from customer where c_acctbal > 0")
def rowfilter(spark, sf):
    return t.rowfilter(read(spark, sf, "customer"), "gt0", ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("t_rowfilter_nonmissing", "select c_custkey from customer where c_name is not null and c_name <> '' and not isnan(c_acctbal)")
def rowfilter_nonmissing(spark, sf):
    return t.rowfilter(read(spark, sf, "customer"), "nonmissing", ["c_name", "c_acctbal"]).select("c_custkey")


@query("t_head", "select c_custkey, c_name from customer order by c_custkey limit 8")
def head(spark, sf):
    return t.head(read(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("t_tail", "select c_custkey, c_name from customer order by c_custkey desc limit 8")
def tail(spark, sf):
    return t.tail(read(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("t_subsref", "select n_name, n_regionkey from nation where n_regionkey = 2")
def subsref(spark, sf):
    return t.subsref(read(spark, sf, "nation"), F.col("n_regionkey") == 2, ["n_name", "n_regionkey"])


@query("t_subsasgn", "select n_nationkey, case when n_regionkey = 2 then 'x' else n_name end as n_name from nation")
def subsasgn(spark, sf):
    return t.subsasgn(read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_name", F.lit("x"), F.col("n_regionkey") == 2).select("n_nationkey", "n_name")


@query("t_rows_by_key", "select s.i as selector, n_name, n_regionkey from (values (0, 'CHINA'), (1, 'BRAZIL')) s(i, n) join nation on n_name = s.n")
def rows_by_key(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_name"), "n_regionkey")
    names = {r.n_name for r in n.collect()}  # a table of 25 rows
    wanted = [x for x in ("CHINA", "BRAZIL") if x in names]
    return t.rows_by_key(n, "n_name", wanted) if wanted else n.limit(0).select(F.lit(0).alias("selector"), "*")


@query("t_table2array", "select k, list_sum(v) as s from (select n_nationkey as k, [n_nationkey::double, n_regionkey::double] as v from nation)")
def table2array(spark, sf):
    d = t.table2array(read(spark, sf, "nation"), ["n_nationkey", "n_regionkey"], ["n_nationkey"])
    return d.select(F.col("n_nationkey").alias("k"), F.aggregate("value", F.lit(0.0), lambda a, x: a + x).alias("s"))


@query("t_array2table", "select vec_id, embedding[1] as a, embedding[2] as b from embeddings")
def array2table(spark, sf):
    return t.array2table(read(spark, sf, "embeddings"), "embedding", ["a", "b"], ["vec_id"])


@query("t_struct_round_trip", "select r_regionkey, r_name from region")
def struct_round_trip(spark, sf):
    return t.struct2table(t.table2struct(read(spark, sf, "region"), ["r_regionkey"]), "s", ["r_regionkey"])


@query("t_table2cell", "select n_nationkey, n_name || '/' || n_regionkey as cells from nation")
def table2cell(spark, sf):
    d = t.table2cell(read(spark, sf, "nation"), ["n_nationkey"])
    return d.select("n_nationkey", F.array_join("cells", "/").alias("cells"))


@query("t_timetable_round_trip", "select o_orderdate as Time, o_orderkey from orders")
def timetable_round_trip(spark, sf):
    return t.timetable2table(t.timetable(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate"))


@query("t_size", "select (select count(*) from part) as height, 6 as width, 6 * (select count(*) from part) as numel")
def size(spark, sf):
    d = read(spark, sf, "part")
    return d.agg(F.count("*").alias("height")).select("height", F.lit(t.width(d)).alias("width"), (F.col("height") * t.width(d)).alias("numel"))


@query("t_orderfields", "select n_name, n_nationkey, n_regionkey from nation")
def orderfields(spark, sf):
    return t.orderfields(read(spark, sf, "nation"))


@query("t_rmfield", "select n_nationkey, n_name from nation")
def rmfield(spark, sf):
    return t.rmfield(read(spark, sf, "nation"), "n_regionkey")


@query("t_structfun", "select n_nationkey, n_regionkey * 2 as n_regionkey from nation")
def structfun(spark, sf):
    return t.structfun(lambda c: c * 2, read(spark, sf, "nation"), ["n_regionkey"], ["n_nationkey"])


@query("t_categorical", "select c_custkey, coalesce(case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 end, 'nan'::double) as code from customer")
def categorical(spark, sf):
    return t.categorical(read(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "code")


@query("t_ordinal", "select o_orderkey, coalesce(left(o_orderpriority, 1) in ('1', '2') and o_orderpriority in ('1-URGENT', '2-HIGH'), false) as high from orders")
def ordinal(spark, sf):
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    d = t.categorical(read(spark, sf, "orders"), "o_orderpriority", order, ordinal=True)
    return d.select("o_orderkey", t.ordinal_compare(d, "o_orderpriority", "<=", "2-HIGH").alias("high"))


@query("t_dictionary", "select n_nationkey, case n_regionkey when 0 then 'a' when 1 then 'b' when 2 then 'z' else 'd' end as v from nation")
def dictionary(spark, sf):
    d = t.dict_put(t.dictionary({0: "a", 1: "b", 2: "c", 3: "d", 4: "d"}), F.lit(2), F.lit("z"))
    return read(spark, sf, "nation").select("n_nationkey", t.lookup(d, F.col("n_regionkey").cast("int")).alias("v"))


@query("t_vertcat", "select 0 as part, n_name as name from nation union all select 1, r_name from region")
def vertcat(spark, sf):
    return t.vertcat(read(spark, sf, "nation").select(F.col("n_name").alias("name")), read(spark, sf, "region").select(F.col("r_name").alias("name"))).select("part", "name")


@query("t_horzcat", "select c_custkey, c_name, c_acctbal from customer")
def horzcat(spark, sf):
    d = read(spark, sf, "customer")
    return t.horzcat(d.select("c_custkey", "c_name"), d.select("c_custkey", "c_acctbal"), ["c_custkey"])


@query("t_number_rows", "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as row_id from orders")
def number_rows(spark, sf):
    return t.number_rows(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_id")


_EV = "(select event_id, user_id, ts, case when event_id % 5 = 0 then 'nan'::double else value end as value from events)"


def _events(spark, sf):
    d = read(spark, sf, "events")
    return d.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))


@query("t_ismissing", f"select event_id, isnan(value) as missing from {_EV}")
def ismissing(spark, sf):
    d = _events(spark, sf)
    return d.select("event_id", t.ismissing(d, "value").alias("missing"))


@query("t_anymissing", f"select bool_or(isnan(value)) as value, bool_or(ts is null) as ts from {_EV}")
def anymissing(spark, sf):
    return t.anymissing(_events(spark, sf), ["value", "ts"])


@query("t_rmmissing", f"select event_id, value from {_EV} where not isnan(value)")
def rmmissing(spark, sf):
    return t.rmmissing(_events(spark, sf), ["value"]).select("event_id", "value")


@query("t_fillmissing_constant", f"select event_id, case when isnan(value) then 9 else value end as value from {_EV}")
def fill_constant(spark, sf):
    return t.fill_constant(_events(spark, sf), 9.0, ["value"]).select("event_id", "value")


@query("t_standardizeMissing", "select p_partkey, case when p_size in (1, 2) then 'nan'::double else p_size end as x from part")
def standardize(spark, sf):
    d = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"))
    return t.standardize_missing(d, [1.0, 2.0], ["x"])


# Grouping ----------------------------------------------------------------------------------------


@query("g_groupsummary", """select o_orderstatus, o_orderpriority, count(*) as GroupCount, round(sum(o_totalprice), 2) + 0.0 as sum_o_totalprice, round(avg(o_totalprice), 2) + 0.0 as mean_o_totalprice, min(o_totalprice) as min_o_totalprice,
  max(o_totalprice) as max_o_totalprice, round(median(o_totalprice), 2) + 0.0 as median_o_totalprice, count(o_totalprice) as count_o_totalprice, count(*) as numel_o_totalprice from orders group by 1, 2""")
def groupsummary(spark, sf):
    return rounded(g.groupsummary(read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["sum", "mean", "min", "max", "median", "count", "numel"], ["o_totalprice"]), 2)


@query("g_groupsummary_nan", f"""select user_id, count(*) as GroupCount, round(coalesce(sum(value) filter (not isnan(value)), 0), 4) + 0.0 as sum_value, round(coalesce(avg(value) filter (not isnan(value)), 'nan'), 4) + 0.0 as mean_value,
  coalesce(min(value) filter (not isnan(value)), 'infinity') as min_value, coalesce(max(value) filter (not isnan(value)), '-infinity') as max_value, count(*) filter (not isnan(value)) as count_value from {_EV} group by 1""")
def groupsummary_nan(spark, sf):
    d = g.groupsummary(_events(spark, sf), ["user_id"], ["sum", "mean", "min", "max", "count"], ["value"])
    return d.select("user_id", "GroupCount", (F.round("sum_value", 4) + 0.0).alias("sum_value"), (F.round("mean_value", 4) + 0.0).alias("mean_value"), "min_value", "max_value", "count_value")


@query("g_pivot", """select l_returnflag, coalesce(round(sum(l_quantity) filter (l_linestatus = 'O'), 2), 'nan'::double) as "O", coalesce(round(sum(l_quantity) filter (l_linestatus = 'F'), 2), 'nan'::double) as "F" from lineitem group by 1""")
def pivot(spark, sf):
    return rounded(g.pivot(read(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", ["O", "F"], "l_quantity"), 2)


@query("g_grpstats", """select c_mktsegment, count(*) as GroupCount, round(avg(c_acctbal), 4) as mean_c_acctbal, round(stddev_samp(c_acctbal), 4) as std_c_acctbal, round(var_samp(c_acctbal), 2) as var_c_acctbal,
  round(stddev_samp(c_acctbal) / sqrt(count(*)), 4) as sem_c_acctbal, round(max(c_acctbal) - min(c_acctbal), 4) as range_c_acctbal, count(*) as numel_c_acctbal from customer where c_mktsegment is not null and c_mktsegment <> '' group by 1""")
def grpstats(spark, sf):
    d = g.grpstats(read(spark, sf, "customer"), ["c_mktsegment"], ["c_acctbal"], ["mean", "std", "var", "sem", "range", "numel"])
    return rounded(d.withColumn("var_c_acctbal", F.round("var_c_acctbal", 2)))


_R = {"sum": "sum(x)", "mean": "avg(x)", "min": "min(x)", "max": "max(x)", "median": "median(x)", "range": "max(x) - min(x)", "var": "coalesce(var_samp(x), 0)", "std": "coalesce(stddev_samp(x), 0)", "varp": "var_pop(x)", "mode": "(select min(m) from (select unnest(list_filter(map_entries(histogram(x)), lambda e: e.value = list_max(map_values(histogram(x))))).key as m))", "sumsq": "sum(x * x)", "norm": "sqrt(sum(x * x))", "mad": "avg(abs(x))", "nnz": "count(*) filter (x <> 0)", "any": "bool_or(x <> 0)", "all": "bool_and(x <> 0)", "allfinite": "bool_and(isfinite(x))", "prod": None}


def _reduction(method: str):
    def run(spark, sf):
        d = read(spark, sf, "part").select("p_brand", (F.col("p_size") - 25).cast("double").alias("x"))
        if method == "prod":
            d = d.withColumn("x", F.when(F.col("x") % 2 == 0, -1.0).otherwise(1.0))
        return rounded(d.groupBy("p_brand").agg(g.reduce_("x", method).alias("r")), 6)

    return run


for _m, _e in _R.items():
    QUERIES[f"g_{_m}"] = _reduction(_m)
    _src = "(select p_brand, (p_size - 25)::double as x from part)"
    if _m == "prod":
        SQL[f"g_{_m}"] = "select p_brand, product(case when (p_size - 25) % 2 = 0 then -1.0 else 1.0 end) + 0.0 as r from part group by 1"
    elif _m == "mode":
        SQL[f"g_{_m}"] = f"select p_brand, x as r from (select p_brand, x, row_number() over (partition by p_brand order by count(*) desc, x) as k from {_src} group by 1, 2) where k = 1"
    else:
        _body = f"round({_e}, 6) + 0.0" if _m not in ("nnz", "any", "all", "allfinite") else _e
        SQL[f"g_{_m}"] = f"select p_brand, {_body} as r from {_src} group by 1"


@query("g_bounds", f"select min(value) filter (not isnan(value)) as lo, max(value) filter (not isnan(value)) as hi from {_EV}")
def bounds(spark, sf):
    return _events(spark, sf).agg(g.bounds("value").alias("b")).select("b.*")


@query("g_quantile", "select p_brand, round(quantile_cont(p_retailprice, 0.1), 4) as q10, round(quantile_cont(p_retailprice, 0.5), 4) as q50, round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 4) as iqr from part group by 1")
def quantile(spark, sf):
    return rounded(read(spark, sf, "part").groupBy("p_brand").agg(g.quantile("p_retailprice", 0.1).alias("q10"), g.prctile("p_retailprice", 50).alias("q50"), g.iqr("p_retailprice").alias("iqr")))


@query("g_mode_counts", "with c as (select p_brand, p_size, count(*) as n from part group by 1, 2), m as (select p_brand, max(n) as n from c group by 1) select c.p_brand, min(p_size) as mode, m.n as frequency, count(*) as ties from c join m on c.p_brand = m.p_brand and c.n = m.n group by c.p_brand, m.n")
def mode_counts(spark, sf):
    return g.mode_counts(read(spark, sf, "part"), "p_size", ["p_brand"]).select("p_brand", "mode", "frequency", F.size("ties").cast("long").alias("ties"))


@query("g_tiedrank", "select p_partkey, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0::double as rank from part")
def tiedrank(spark, sf):
    return g.tiedrank(read(spark, sf, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "rank")


@query("g_tiedrank_groups", "select p_partkey, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0::double as rank from part")
def tiedrank_groups(spark, sf):
    return g.tiedrank(read(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"]).select("p_partkey", "rank")


@query("g_tieadj", "select sum(t * t * t - t) as tieadj from (select count(*)::double as t from part group by p_size)")
def tieadj(spark, sf):
    return g.tie_adjustment(read(spark, sf, "part"), "p_size")


@query("g_ecdf", "select p_size::double as x, round(sum(count(*)) over (order by p_size)::double / (select count(*) from part), 9) as f from part group by p_size")
def ecdf(spark, sf):
    return rounded(g.ecdf(read(spark, sf, "part"), "p_size").select("x", "f"), 9)


@query("g_kaplan_meier", """with v as (select p_size::double as x, sum(case when p_partkey % 3 = 0 then 0 else 1 end) as d, count(*) as c from part group by 1),
  r as (select x, d, (select count(*) from part) - sum(c) over (order by x) + c as risk from v)
  select x, round(case when bool_or(d = risk) over w then 0 else exp(sum(case when d < risk then ln(1 - d::double / risk) else 0 end) over w) end, 6) + 0.0 as survivor from r where d > 0 window w as (order by x)""")
def kaplan_meier(spark, sf):
    d = read(spark, sf, "part").withColumn("c", F.col("p_partkey") % 3 == 0)
    return rounded(g.kaplan_meier(d, "p_size", "c"), 6)


@query("g_corr", "select round(corr(l_quantity, l_extendedprice), 6) as r, round(covar_samp(l_quantity, l_extendedprice), 3) as c from lineitem")
def corr(spark, sf):
    d = read(spark, sf, "lineitem").agg(g.corr("l_quantity", "l_extendedprice").alias("r"), g.cov("l_quantity", "l_extendedprice").alias("c"))
    return d.select(F.round("r", 6).alias("r"), F.round("c", 3).alias("c"))


@query("g_corrcoef", "select i, j, round(case when i = j then 1.0 else (select corr(l_quantity, l_discount) from lineitem) end, 6) + 0.0 as value from (values (1, 1), (1, 2), (2, 1), (2, 2)) t(i, j)")
def corrcoef(spark, sf):
    return rounded(g.corrcoef(read(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), 6)


@query("g_cov_corrcov", "select i, j, round(case when i = j then 1.0 else (select corr(l_quantity, l_discount) from lineitem) end, 6) + 0.0 as value from (values (1, 1), (1, 2), (2, 1), (2, 2)) t(i, j)")
def corrcov(spark, sf):
    return rounded(g.corrcov(g.covmatrix(read(spark, sf, "lineitem"), ["l_quantity", "l_discount"])).drop("sigma"), 6)


@query("g_spearman", "with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part) select round(corr(a, b), 6) + 0.0 as rho from r")
def spearman(spark, sf):
    return rounded(g.spearman(read(spark, sf, "part"), "p_size", "p_retailprice"), 6)


@query("g_kendall", """with p as (select n_nationkey % 4 as a, n_regionkey as b, n_nationkey as k from nation), c as (select sum(sign(x.a - y.a) * sign(x.b - y.b))::double as s, count(*) filter (x.a <> y.a)::double as na, count(*) filter (x.b <> y.b)::double as nb from p x join p y on x.k < y.k)
  select round(s / sqrt(na * nb), 6) + 0.0 as tau from c""")
def kendall(spark, sf):
    return rounded(g.kendall(read(spark, sf, "nation").select((F.col("n_nationkey") % 4).alias("a"), F.col("n_regionkey").alias("b")), "a", "b"), 6)


@query("g_histc", "select b.bin::int as bin, (select count(*) from part where case when b.bin = 6 then p_size = 50 else p_size >= (b.bin - 1) * 10 and p_size < b.bin * 10 end) as count from range(1, 7) b(bin)")
def histc(spark, sf):
    return g.histc(read(spark, sf, "part"), "p_size", [0, 10, 20, 30, 40, 50])


@query("g_histcounts", "select b.bin::int as bin, (select count(*) from part where p_size >= (b.bin - 1) * 10 and (p_size < b.bin * 10 or (b.bin = 5 and p_size = 50))) as count from range(1, 6) b(bin)")
def histcounts(spark, sf):
    return g.histcounts(read(spark, sf, "part"), "p_size", [0, 10, 20, 30, 40, 50])


@query("g_histcounts2", "select least(floor(p_size / 25), 1)::int + 1 as xbin, least(floor((p_partkey % 10) / 5), 1)::int + 1 as ybin, count(*) as count from part where p_size between 0 and 50 group by 1, 2")
def histcounts2(spark, sf):
    d = read(spark, sf, "part").withColumn("m", F.col("p_partkey") % 10)
    return g.histcounts2(d, "p_size", "m", [0, 25, 50], [0, 5, 10])


@query("g_polarhistogram", "select b.bin::int as bin, (select count(*) from part where floor((p_size - floor(p_size / (2 * pi())) * 2 * pi()) / (pi() / 3)) = b.bin - 1) as count from range(1, 7) b(bin)")
def polarhistogram(spark, sf):
    return g.polarhistogram(read(spark, sf, "part"), "p_size", 6)


@query("g_imhist", "select b.bin::int as bin, (select count(*) from part where floor(p_size / 50.0::double * 9 + 0.5) = b.bin - 1) as count from range(1, 11) b(bin)")
def imhist(spark, sf):
    return g.imhist(read(spark, sf, "part").withColumn("v", F.col("p_size") / 50), "v", 10)


@query("g_pie", "select c_mktsegment, round(sum(c_acctbal) / (select sum(c_acctbal) from customer), 6) as share from customer group by 1")
def pie(spark, sf):
    return rounded(g.pie(read(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal"), 6)


@query("g_heatmap", "select l_returnflag, l_linestatus, round(avg(l_tax), 6) as value from lineitem group by 1, 2")
def heatmap(spark, sf):
    return rounded(g.heatmap(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_tax"), 6)


@query("g_boxplot", "select c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 4) as q1, round(median(c_acctbal), 4) as median, round(quantile_cont(c_acctbal, 0.75), 4) as q3, min(c_acctbal) as lo, max(c_acctbal) as hi from customer group by 1")
def boxplot(spark, sf):
    return rounded(g.boxplot(read(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"]))


@query("g_lsline", "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept from lineitem group by 1")
def lsline(spark, sf):
    d = g.lsline(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return d.select("l_returnflag", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("g_qqplot", "select (generate_subscripts(q, 1) - 1)::int as k, round(unnest(q), 4) as sample from (select quantile_cont(p_retailprice, [" + ", ".join(f"{(k - 0.5) / 9!r}" for k in range(1, 10)) + "]) as q from part)")
def qqplot(spark, sf):
    return rounded(g.qqplot(read(spark, sf, "part"), "p_retailprice", 9).drop("normal"))


@query("g_findgroups", "select c_custkey, dense_rank() over (order by c_mktsegment)::int as g from customer")
def findgroups(spark, sf):
    return g.findgroups(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"]).select("c_custkey", F.col("group").alias("g"))


@query("g_accumarray", "select n_regionkey, sum(n_nationkey)::double as value from nation group by 1")
def accumarray(spark, sf):
    return g.accumarray(read(spark, sf, "nation"), ["n_regionkey"], "n_nationkey")


@query("g_splitapply", "select n_regionkey, count(*) as n from nation group by 1")
def splitapply(spark, sf):
    import pandas as pd

    return g.splitapply(read(spark, sf, "nation").select("n_regionkey"), ["n_regionkey"], lambda p: pd.DataFrame({"n_regionkey": [p["n_regionkey"].iloc[0]], "n": [len(p)]}), "n_regionkey int, n long")


# Order and sets ----------------------------------------------------------------------------------


@query("o_sortrows", "select c_custkey, row_number() over (order by c_nationkey desc, c_acctbal, c_custkey) as k from customer")
def sortrows(spark, sf):
    d = t.number_rows(read(spark, sf, "customer").withColumn("m", -F.col("c_nationkey")), ["m", "c_acctbal", "c_custkey"], "k")
    return d.select("c_custkey", "k")


@query("o_argsort", f"select event_id, row_number() over (order by value, event_id) as place from {_EV}")
def argsort(spark, sf):
    return o.argsort(_events(spark, sf), "value", ["event_id"]).select("event_id", "place")


@query("o_argsort_descend", f"select event_id, row_number() over (order by value desc, event_id) as place from {_EV}")
def argsort_descend(spark, sf):
    return o.argsort(_events(spark, sf), "value", ["event_id"], descend=True).select("event_id", "place")


@query("o_argsort_groups", f"select event_id, row_number() over (partition by user_id order by abs(value), event_id) as place from {_EV}")
def argsort_groups(spark, sf):
    return o.argsort(_events(spark, sf), "value", ["event_id"], ["user_id"], magnitude=True).select("event_id", "place")


@query("o_issortedrows", "select l_orderkey, bool_and(ok) as sorted from (select l_orderkey, coalesce(lag(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey) <= l_quantity, true) as ok from lineitem) group by 1")
def issortedrows(spark, sf):
    return o.issorted(read(spark, sf, "lineitem"), "l_quantity", ["l_linenumber", "l_partkey"], ["l_orderkey"])


@query("o_maxk", f"select user_id, event_id, place from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as place from {_EV}) where place <= 3")
def maxk(spark, sf):
    return o.maxk(_events(spark, sf), "value", 3, ["event_id"], ["user_id"]).select("user_id", "event_id", "place")


@query("o_mink", f"select event_id, place from (select event_id, row_number() over (order by value, event_id) as place from {_EV}) where place <= 5")
def mink(spark, sf):
    return o.mink(_events(spark, sf), "value", 5, ["event_id"]).select("event_id", "place")


@query("o_unique", "select p_brand, min(p_partkey) as p_partkey, count(*) as count from part group by 1")
def unique(spark, sf):
    return o.unique(read(spark, sf, "part"), ["p_brand"], ["p_partkey"])


def _sets(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf, "supplier").select((F.col("s_nationkey") + 5).alias("k"))


for _n, _op in (("union", "union"), ("intersect", "intersect"), ("setdiff", "except")):
    QUERIES[f"o_{_n}"] = (lambda f: lambda spark, sf: f(*_sets(spark, sf)))(getattr(o, _n))
    SQL[f"o_{_n}"] = f"select c_nationkey as k from customer {_op} select s_nationkey + 5 from supplier"
QUERIES["o_setxor"] = lambda spark, sf: o.setxor(*_sets(spark, sf))
SQL["o_setxor"] = "(select c_nationkey as k from customer except select s_nationkey + 5 from supplier) union all (select s_nationkey + 5 from supplier except select c_nationkey from customer)"


@query("o_ismember", "select c_custkey, c_nationkey in (select s_nationkey from supplier where s_acctbal < 2000) as member, (select min(s_suppkey) from supplier where s_nationkey = c_nationkey and s_acctbal < 2000) as locb from customer")
def ismember(spark, sf):
    b = read(spark, sf, "supplier").filter("s_acctbal < 2000").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    d = o.ismember(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), b, ["c_nationkey"], ["s_suppkey"])
    return d.select("c_custkey", "member", F.col("locb.s_suppkey").alias("locb"))


@query("o_ismembertol", """with m as (select 1e-4 * greatest((select max(abs(c_acctbal)) from customer), (select max(abs(s_acctbal)) from supplier)) as t)
  select c_custkey, (select min(s_suppkey) from supplier where abs(s_acctbal - c_acctbal) <= (select t from m)) is not null as member, (select min(s_suppkey) from supplier where abs(s_acctbal - c_acctbal) <= (select t from m)) as locb from customer""")
def ismembertol(spark, sf):
    return o.ismembertol(read(spark, sf, "customer"), read(spark, sf, "supplier"), "c_acctbal", "s_acctbal", 1e-4, "s_suppkey").select("c_custkey", "member", "locb")


@query("o_isequal", "select true as same, false as different")
def isequal(spark, sf):
    a = read(spark, sf, "nation")
    return spark.createDataFrame([(o.isequal(a, a.orderBy("n_name")), o.isequal(a, a.filter("n_nationkey > 0")))], "same boolean, different boolean")


@query("o_combvec", "select n_name, r_name from nation, region")
def combvec(spark, sf):
    return o.combvec(read(spark, sf, "nation").select("n_name"), read(spark, sf, "region").select("r_name"))


@query("o_innerjoin", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def innerjoin(spark, sf):
    return o.innerjoin(read(spark, sf, "nation"), read(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]).select("n_name", "r_name")


# Windows -----------------------------------------------------------------------------------------


@query("w_cumsum", "select o_orderkey, round(sum(o_totalprice) over (order by o_orderdate, o_orderkey), 2) as cumsum from orders")
def cumsum(spark, sf):
    return rounded(w.cumsum(read(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_totalprice", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "cumsum"), 2)


@query("w_cumsum_groups", f"select event_id, round(sum(case when isnan(value) then 0 else value end) over (partition by user_id order by ts, event_id), 4) + 0.0 as cumsum from {_EV}")
def cumsum_groups(spark, sf):
    return rounded(w.cumsum(_events(spark, sf), "value", ["ts", "event_id"], ["user_id"], omit=True).select("event_id", "cumsum"))


@query("w_cumprod", "select p_partkey, round(exp(sum(ln(1 + p_size / 1000.0::double)) over (partition by p_brand order by p_partkey)), 4) as cumprod from part")
def cumprod(spark, sf):
    d = read(spark, sf, "part").withColumn("x", 1 + F.col("p_size") / 1000)
    return rounded(w.cumprod(d, "x", ["p_partkey"], ["p_brand"]).select("p_partkey", "cumprod"))


@query("w_cummax", "select p_partkey, max(p_retailprice) over (order by p_partkey) as cummax from part")
def cummax(spark, sf):
    return w.cummax(read(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", ["p_partkey"]).select("p_partkey", "cummax")


@query("w_cummin", "select p_partkey, min(p_retailprice) over (partition by p_brand order by p_partkey) as cummin from part")
def cummin(spark, sf):
    return w.cummin(read(spark, sf, "part"), "p_retailprice", ["p_partkey"], ["p_brand"]).select("p_partkey", "cummin")


@query("w_diff", "select * from (select o_orderkey, round(o_totalprice - lag(o_totalprice) over w, 2) + 0.0 as diff from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) where diff is not null")
def diff(spark, sf):
    return rounded(w.diff(read(spark, sf, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "diff"), 2)


@query("w_diff2", "select * from (select o_orderkey, round(o_totalprice - 2 * lag(o_totalprice) over w + lag(o_totalprice, 2) over w, 2) + 0.0 as diff from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) where diff is not null")
def diff2(spark, sf):
    return rounded(w.diff(read(spark, sf, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_custkey"], 2).select("o_orderkey", "diff"), 2)


@query("w_gradient", """select o_orderkey, round(case when b is null and a is null then 0 when b is null then a - x when a is null then x - b else (a - b) / 2 end, 4) + 0.0 as gradient
  from (select o_orderkey, o_totalprice as x, lag(o_totalprice) over w as b, lead(o_totalprice) over w as a from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))""")
def gradient(spark, sf):
    return rounded(w.gradient(read(spark, sf, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "gradient"), 4)


_TR = "(select l_orderkey, l_linenumber, (l_linenumber - lag(l_linenumber) over w) * (l_quantity + lag(l_quantity) over w) / 2 as d from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey))"


@query("w_trapz", "select p_brand, round(coalesce(sum(d), 0), 4) as integral from (select p_brand, (p_partkey - lag(p_partkey) over w) * (p_size + lag(p_size) over w) / 2.0::double as d from part window w as (partition by p_brand order by p_partkey)) group by 1")
def trapz(spark, sf):
    return rounded(w.trapz(read(spark, sf, "part"), "p_partkey", "p_size", ["p_brand"]))


@query("w_cumtrapz", "select p_partkey, round(sum(coalesce(d, 0)) over (partition by p_brand order by p_partkey), 4) + 0.0 as integral from (select p_brand, p_partkey, (p_partkey - lag(p_partkey) over w) * (p_size + lag(p_size) over w) / 2.0::double as d from part window w as (partition by p_brand order by p_partkey))")
def cumtrapz(spark, sf):
    return rounded(w.cumtrapz(read(spark, sf, "part"), "p_partkey", "p_size", ["p_brand"]).select("p_partkey", "integral"))


for _m, _e in {"mean": "avg(v)", "sum": "coalesce(sum(v), 0)", "min": "min(v)", "max": "max(v)", "std": "coalesce(stddev_samp(v), case when count(v) > 0 then 0 end)", "median": "median(v)"}.items():
    QUERIES[f"w_mov{_m}"] = (lambda m: lambda spark, sf: rounded(w.moving(_events(spark, sf), "value", 5, m, ["ts", "event_id"], ["user_id"]).select("event_id", "moving"), 4))(_m)
    _over = " over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following)"
    _e = _e.replace("avg(v)", "avg(v)" + _over).replace("sum(v)", "sum(v)" + _over).replace("min(v)", "min(v)" + _over).replace("max(v)", "max(v)" + _over).replace("stddev_samp(v)", "stddev_samp(v)" + _over).replace("count(v)", "count(v)" + _over).replace("median(v)", "median(v)" + _over)
    SQL[f"w_mov{_m}"] = f"select event_id, round(coalesce({_e}, 'nan'::double), 4) + 0.0 as moving from (select *, case when isnan(value) then null else value end as v from {_EV})"


@query("w_movmad", "select p_partkey, round(list_median(list_transform(a, lambda x: abs(x - list_median(a)))), 6) + 0.0 as moving from (select p_partkey, list(p_size::double) over (partition by p_brand order by p_partkey rows between 1 preceding and 1 following) as a from part)")
def movmad(spark, sf):
    return rounded(w.moving(read(spark, sf, "part"), "p_size", 3, "mad", ["p_partkey"], ["p_brand"]).select("p_partkey", "moving"), 6)


@query("w_unwrap", """with d as (select p_partkey, p_brand, (p_size % 7)::double as x, (p_size % 7)::double - lag((p_size % 7)::double) over (partition by p_brand order by p_partkey) as d from part),
  f as (select *, case when abs(d) > pi() then (d + pi() - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi()) - d else 0 end as f from d)
  select p_partkey, round(x + sum(coalesce(f, 0)) over (partition by p_brand order by p_partkey), 6) + 0.0 as unwrapped from f""")
def unwrap(spark, sf):
    d = read(spark, sf, "part").withColumn("x", (F.col("p_size") % 7).cast("double"))
    return rounded(w.unwrap(d, "x", ["p_partkey"], ["p_brand"]).select("p_partkey", "unwrapped"), 6)


@query("w_macd", """with recursive p as (select s_suppkey, s_acctbal as x, s_nationkey as g, row_number() over (partition by s_nationkey order by s_suppkey) as k from supplier),
  e as (select g, k, s_suppkey, x as f, x as s, 0.0::double as sig from p where k = 1
    union all select p.g, p.k, p.s_suppkey, e.f + 0.15 * (p.x - e.f), e.s + 0.075 * (p.x - e.s), e.sig + 0.2 * ((e.f + 0.15 * (p.x - e.f)) - (e.s + 0.075 * (p.x - e.s)) - e.sig) from e join p on p.g = e.g and p.k = e.k + 1)
  select s_suppkey, round(f - s, 6) + 0.0 as macd, round(sig, 6) + 0.0 as signal from e""")
def macd(spark, sf):
    return rounded(w.macd(read(spark, sf, "supplier"), "s_acctbal", ["s_suppkey"], ["s_nationkey"]).select("s_suppkey", "macd", "signal"), 6)


@query("w_rescale", "select c_custkey, round((c_acctbal - (select min(c_acctbal) from customer)) / ((select max(c_acctbal) from customer) - (select min(c_acctbal) from customer)), 9) + 0.0 as rescaled from customer")
def rescale(spark, sf):
    return rounded(w.rescale(read(spark, sf, "customer"), "c_acctbal").select("c_custkey", "rescaled"), 9)


@query("w_normalize", "select c_custkey, round((c_acctbal - avg(c_acctbal) over w) / stddev_samp(c_acctbal) over w, 6) + 0.0 as normalized from customer window w as (partition by c_mktsegment)")
def normalize(spark, sf):
    return rounded(w.normalize(read(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", "normalized"), 6)


@query("w_fillmissing_previous", f"select event_id, coalesce(last_value(case when isnan(value) then null else value end ignore nulls) over (partition by user_id order by ts, event_id), 'nan') as filled from {_EV}")
def fillmissing_previous(spark, sf):
    return w.fillmissing(_events(spark, sf), "value", "previous", ["ts", "event_id"], ["user_id"]).select("event_id", "filled")


@query("w_fillmissing_next", f"select event_id, coalesce(first_value(case when isnan(value) then null else value end ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following), 'nan') as filled from {_EV}")
def fillmissing_next(spark, sf):
    return w.fillmissing(_events(spark, sf), "value", "next", ["ts", "event_id"], ["user_id"]).select("event_id", "filled")


@query("w_fillmissing_linear", f"""with e as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as k, case when isnan(value) then null else value end as v from {_EV}), g as (select * from e where v is not null),
  q as (select e.*, (select max(k) from g where g.user_id = e.user_id and g.k <= e.k) as p, (select min(k) from g where g.user_id = e.user_id and g.k >= e.k) as n from e)
  select q.event_id, round(coalesce(q.v, a.v + (b.v - a.v) * (q.k - a.k) / (b.k - a.k)), 6) + 0.0 as filled from q join g a on a.user_id = q.user_id and a.k = q.p join g b on b.user_id = q.user_id and b.k = q.n""")
def fillmissing_linear(spark, sf):
    d = w.fillmissing(_events(spark, sf), "value", "linear", ["ts", "event_id"], ["user_id"])
    # The SQL covers rows between two known ones.
    e = _events(spark, sf).filter("not isnan(value)").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id")).alias("b"))
    d = d.join(e, "user_id").filter((F.struct("ts", "event_id") >= F.col("a")) & (F.struct("ts", "event_id") <= F.col("b")))
    return rounded(d.select("event_id", "filled"), 6)


@query("w_isoutlier", "select c_custkey, abs(c_acctbal - m) > 1.5 * 1.4826 * s as outlier from (select *, median(abs(c_acctbal - m)) over (partition by c_mktsegment) as s from (select *, median(c_acctbal) over (partition by c_mktsegment) as m from customer))")
def isoutlier(spark, sf):
    return w.isoutlier(read(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"], 1.5).select("c_custkey", "outlier")


@query("w_interp1", """with p as (select p_partkey::double as x, p_retailprice as y from part where p_size >= 45), q as (select p_partkey::double as x from part)
  select q.x, round(case when a.x = q.x then a.y else coalesce(a.y + (b.y - a.y) * (q.x - a.x) / nullif(b.x - a.x, 0), 'nan') end, 6) + 0.0 as y from q
  left join p a on a.x = (select max(x) from p where p.x <= q.x) left join p b on b.x = (select min(x) from p where p.x >= q.x)""")
def interp1(spark, sf):
    d = read(spark, sf, "part")
    return rounded(w.interp1(d.filter("p_size >= 45"), d.select(F.col("p_partkey").alias("q")), "p_partkey", "p_retailprice", "q").select(F.col("q").alias("x"), F.col("p_retailprice").alias("y")), 6)


@query("w_asof_join", "select e.event_id, p.value as value from events e asof left join (select user_id, ts, value from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts >= p.ts where e.event_type <> 'purchase'")
def asof_join(spark, sf):
    d = read(spark, sf, "events")
    return w.asof_join(d.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), d.filter("event_type = 'purchase'").select("user_id", "ts", "value"), "ts", ["user_id"], "value").select("event_id", "value")


# Text --------------------------------------------------------------------------------------------

_WORDS = "(select {k}, unnest(regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}]+)*')) as word from {d})"


@query("x_bag_of_words", "select doc_id, word, count(*) as count from " + _WORDS.format(k="doc_id", t="text", d="documents") + " group by 1, 2")
def bag_of_words(spark, sf):
    return tx.bag_of_words(read(spark, sf, "documents"), "doc_id", "text")


@query("x_bag_of_ngrams", "with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}]+)*') as a from documents) select doc_id, ngram, count(*) as count from (select doc_id, unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) as ngram from w) group by 1, 2")
def bag_of_ngrams(spark, sf):
    return tx.bag_of_ngrams(read(spark, sf, "documents"), "doc_id", "text")


@query("x_vocabulary", "with w as (select doc_id, unnest(a) as word, generate_subscripts(a, 1) as place from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}]+)*') as a from documents)), v as (select word, min(doc_id * 1000000 + place) as pos, count(*) as count from w group by 1) select word, row_number() over (order by pos) as \"index\", count from v")
def vocabulary(spark, sf):
    return tx.vocabulary(read(spark, sf, "documents"), "doc_id", "text")


@query("x_topkwords", "select word, count(*) as count from " + _WORDS.format(k="doc_id", t="text", d="documents") + " group by 1 order by 2 desc, 1 limit 10")
def topkwords(spark, sf):
    return tx.topkwords(tx.bag_of_words(read(spark, sf, "documents"), "doc_id", "text"), 10)


@query("x_tfidf_cosine", "with b as (select item_id, word, count(*) as c from " + _WORDS.format(k="item_id", t="text", d="benchmark") + " group by 1, 2), f as (select word, ln((select count(*) from benchmark)::double / count(*)) as idf from b group by 1), x as (select item_id, word, c * idf as w from b join f using (word) where idf <> 0), n as (select item_id, sqrt(sum(w * w)) as n from x group by 1) select p.item_id as a, q.item_id as b, round(sum(p.w * q.w) / (n1.n * n2.n), 6) as cosine from x p join x q on p.word = q.word join n n1 on n1.item_id = p.item_id join n n2 on n2.item_id = q.item_id group by p.item_id, q.item_id, n1.n, n2.n")
def tfidf_cosine(spark, sf):
    d = read(spark, sf, "benchmark")
    x = tx.tfidf(tx.bag_of_words(d, "item_id", "text"), "item_id", d.count())
    return rounded(tx.cosine_similarity(x, x, "item_id"), 6)


@query("x_html_text", r"select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) as text from pages")
def html_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.html_text("html").alias("text"))


@query("x_sentiment")
def sentiment(spark, sf):
    return tx.sentiment(read(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), "text"), "k", "text")


@query("x_word2ind", "with v as (select n_name as word, n_nationkey::double as index from nation where n_name < 'J') select n_nationkey, coalesce(v.index, 'nan') as index from nation left join v on n_name = word")
def word2ind(spark, sf):
    n = read(spark, sf, "nation")
    v = n.filter("n_name < 'J'").select(F.col("n_name").alias("word"), F.col("n_nationkey").alias("index"))
    return tx.word2ind(n, "n_name", v).select("n_nationkey", "index")


@query("x_remove_stop_words", "select count(*) as n from " + _WORDS.format(k="doc_id", t="text", d="documents") + " where word not in (" + ", ".join(f"'{x}'" for x in tx.STOP_WORDS) + ")")
def stop_words(spark, sf):
    return tx.remove_words(tx.words(read(spark, sf, "documents"), "doc_id", "text")).agg(F.count("*").alias("n"))


# Matrices, series, statistics ---------------------------------------------------------------------

_M = "(select o_custkey % 20 + 1 as i, o_orderkey % 15 + 1 as j, round(sum(o_totalprice), 2) as v from orders group by 1, 2)"


def _matrix(spark, sf):
    d = read(spark, sf, "orders")
    return d.groupBy((F.col("o_custkey") % 20 + 1).alias("i"), (F.col("o_orderkey") % 15 + 1).alias("j")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


@query("l_mtimes", f"select a.i, b.i as j, round(sum(a.v * b.v) / 1e9, 4) as v from {_M} a join {_M} b on a.j = b.j group by 1, 2")
def mtimes(spark, sf):
    m = _matrix(spark, sf)
    return la.mtimes(m, la.transpose(m)).select("i", "j", F.round(F.col("v") / 1e9, 4).alias("v"))


@query("l_transpose", f"select j as i, i as j, v from {_M}")
def transpose(spark, sf):
    return la.transpose(_matrix(spark, sf))


@query("l_trace", f"select round(sum(v), 2) as trace from {_M} where i = j")
def trace(spark, sf):
    return rounded(la.trace(_matrix(spark, sf)), 2)


@query("l_norms", f"select round((select max(s) from (select sum(abs(v)) as s from {_M} group by j)), 1) as one, round((select max(s) from (select sum(abs(v)) as s from {_M} group by i)), 1) as inf, round(sqrt(sum(v * v)), 1) as fro from {_M}")
def norms(spark, sf):
    return rounded(la.norms(_matrix(spark, sf)), 1)


@query("l_vecnorm", f"select j, round(sqrt(sum(v * v)), 2) as norm from {_M} group by 1")
def vecnorm(spark, sf):
    return rounded(la.vecnorm(_matrix(spark, sf)), 2)


@query("l_tril", f"select i, j, v from {_M} where j - i <= -1")
def tril(spark, sf):
    return la.tril(_matrix(spark, sf), -1)


@query("l_triu", f"select i, j, v from {_M} where j >= i")
def triu(spark, sf):
    return la.triu(_matrix(spark, sf))


@query("l_diag", f"select i, v from {_M} where i = j")
def diag(spark, sf):
    return la.diag(_matrix(spark, sf))


@query("l_bandwidth", f"select max(greatest(i - j, 0)) as lower, max(greatest(j - i, 0)) as upper from {_M} where v <> 0")
def bandwidth(spark, sf):
    return la.bandwidth(_matrix(spark, sf))


@query("l_structure", "select true as isdiag, true as istril, true as istriu, true as issymmetric")
def structure(spark, sf):
    return la.structure(la.eye(spark, 5))


@query("l_kron", f"select (a.i - 1) * 2 + b.i as i, (a.j - 1) * 2 + b.j as j, a.v * b.v as v from {_M} a, (values (1, 1, 1.0::double), (2, 2, 1.0::double)) b(i, j, v)")
def kron(spark, sf):
    return la.kron(_matrix(spark, sf), la.eye(spark, 2), 2, 2)


@query("l_rot90", f"select 15 + 1 - j as i, i as j, v from {_M}")
def rot90(spark, sf):
    return la.rot90(_matrix(spark, sf), 15)


@query("l_flip", f"select 20 + 1 - i as i, 15 + 1 - j as j, v from {_M}")
def flip(spark, sf):
    return la.fliplr(la.flipud(_matrix(spark, sf), 20), 15)


@query("l_reshape", f"select ((j - 1) * 20 + i - 1) % 10 + 1 as i, ((j - 1) * 20 + i - 1) // 10 + 1 as j, v from {_M}")
def reshape(spark, sf):
    return la.reshape(_matrix(spark, sf), 20, 10)


@query("l_toeplitz", "select i, j, [3.0::double, 1.0, 4.0][abs(i - j) + 1] as v from range(1, 4) a(i), range(1, 4) b(j)")
def toeplitz(spark, sf):
    return la.toeplitz(spark, [3, 1, 4])


@query("l_meshgrid", "select i, j, j * 10.0::double as x, i * 5.0::double as y from range(1, 4) a(i), range(1, 3) b(j)")
def meshgrid(spark, sf):
    return la.meshgrid(spark, [10, 20], [5, 10, 15])


@query("l_regress", "select round(regr_slope(l_extendedprice, l_quantity), 3) as slope, round(regr_intercept(l_extendedprice, l_quantity), 1) as intercept, round(regr_r2(l_extendedprice, l_quantity), 5) as r2 from lineitem")
def regress(spark, sf):
    r = la.regress(read(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(r["b"][1]), 3), round(float(r["b"][0]), 1), round(float(r["r2"]), 5))], "slope double, intercept double, r2 double")


@query("l_polyfit", "select round(regr_slope(p_retailprice, p_partkey), 6) as slope from part")
def polyfit(spark, sf):
    p = la.polyfit(read(spark, sf, "part"), "p_partkey", "p_retailprice", 1)
    return spark.createDataFrame([(round(float(p[0]), 6),)], "slope double")


@query("s_fir", "select o_orderkey, round(o_totalprice - coalesce(lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey), 0), 2) + 0.0 as filtered from orders")
def fir(spark, sf):
    return rounded(sg.fir(read(spark, sf, "orders"), "o_totalprice", [1, -1], ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "filtered"), 2)


@query("s_conv", "with a as (select s_nationkey as g, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as k, s_acctbal as v from supplier), b(k, v) as (values (0, 1.0::double), (1, 2.0::double)) select g, a.k + b.k as k, round(sum(a.v * b.v), 2) + 0.0 as v from a, b group by 1, 2")
def conv(spark, sf):
    from pyspark.sql import Window

    d = read(spark, sf, "supplier")
    a = d.select(F.col("s_nationkey").alias("g"), (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("long").alias("k"), F.col("s_acctbal").alias("v"))
    b = a.select("g").dropDuplicates().select("g", F.inline(F.expr("array(struct(0L as k, 1D as v), struct(1L as k, 2D as v))")))
    return rounded(sg.conv(a, b, ["g"]), 2)


@query("s_conv2", f"select i + p as i, j + q as j, round(sum(v), 2) as v from {_M}, (values (0), (1)) a(p), (values (0), (1)) b(q) group by 1, 2")
def conv2(spark, sf):
    return rounded(sg.conv2(_matrix(spark, sf), [[1, 1], [1, 1]]), 2)


@query("s_fft", """with p as (select s_nationkey as g, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as n, count(*) over (partition by s_nationkey) as m, s_acctbal as v from supplier), k as (select distinct g, m, unnest(range(0, m)) as k from p)
  select p.g as s_nationkey, k.k + 1 as k, round(sum(v * cos(2 * pi() * k.k * p.n / p.m)), 4) + 0.0 as re, round(-sum(v * sin(2 * pi() * k.k * p.n / p.m)), 4) + 0.0 as im from p join k on p.g = k.g group by p.g, k.k""")
def fft(spark, sf):
    return rounded(sg.fft(read(spark, sf, "supplier"), "s_acctbal", ["s_suppkey"], ["s_nationkey"]))


@query("s_ifft", "select s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey) as k, round(s_acctbal, 4) + 0.0 as value from supplier")
def ifft(spark, sf):
    return rounded(sg.ifft(sg.fft(read(spark, sf, "supplier"), "s_acctbal", ["s_suppkey"], ["s_nationkey"]), ["s_nationkey"]))


@query("s_iir", """with recursive p as (select s_nationkey as g, row_number() over (partition by s_nationkey order by s_suppkey) as k, s_acctbal as x from supplier),
  e as (select g, k, x as y from p where k = 1 union all select p.g, p.k, p.x + 0.5 * e.y from e join p on p.g = e.g and p.k = e.k + 1) select g as s_nationkey, k, round(y, 3) + 0.0 as y from e""")
def iir(spark, sf):
    return rounded(sg.iir(read(spark, sf, "supplier"), "s_acctbal", [1], [1, -0.5], ["s_suppkey"], ["s_nationkey"]), 3)


@query("s_filtfilt")
def filtfilt(spark, sf):
    return sg.filtfilt(read(spark, sf, "supplier"), "s_acctbal", [0.5], [1, -0.5], ["s_suppkey"], ["s_nationkey"])


@query("s_hilbert")
def hilbert(spark, sf):
    return sg.hilbert(read(spark, sf, "supplier"), "s_acctbal", ["s_suppkey"], ["s_nationkey"])


@query("s_periodogram")
def periodogram(spark, sf):
    return sg.periodogram(read(spark, sf, "supplier"), "s_acctbal", ["s_suppkey"], ["s_nationkey"])


@query("m_confusionmat", "select i, j, (select count(*) from labels where quality = i - 1 and toxic = j - 1) as count from range(1, 3) a(i), range(1, 3) b(j)")
def confusionmat(spark, sf):
    d = ss.confusionmat(read(spark, sf, "labels"), "quality", "toxic", [0, 1])
    return d.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "count")


@query("m_crossvalind", "select x::int as fold, (select count(*) from customer) // 5 as n from range(1, 6) t(x)")
def crossvalind(spark, sf):
    # 5 divides the customers of every scale.
    return ss.crossvalind(read(spark, sf, "customer"), 5, ["c_custkey"]).groupBy("fold").agg(F.count("*").alias("n"))


@query("m_onehot", "select c_custkey, (c_mktsegment = 'BUILDING')::int as c_mktsegment_BUILDING, (c_mktsegment = 'MACHINERY')::int as c_mktsegment_MACHINERY from customer")
def onehot(spark, sf):
    return ss.onehot(read(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment_BUILDING", "c_mktsegment_MACHINERY")


@query("m_knnsearch", "select q as vec_id, place, p as neighbour from (select a.vec_id as q, b.vec_id as p, row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as place from embeddings a, embeddings b where a.vec_id % 100 = 0) where place <= 3")
def knnsearch(spark, sf):
    e = read(spark, sf, "embeddings")
    return ss.knnsearch(e, e.filter("vec_id % 100 = 0"), "vec_id", "vec_id", "embedding", 3).select("vec_id", "place", "neighbour")


@query("m_pdist", "select a.n_nationkey as a, b.n_nationkey as b, round(sqrt(pow(a.n_nationkey - b.n_nationkey, 2) + pow(a.n_regionkey - b.n_regionkey, 2)), 6) as distance from nation a join nation b on a.n_nationkey < b.n_nationkey")
def pdist(spark, sf):
    d = read(spark, sf, "nation").select("n_nationkey", F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")).alias("v"))
    return rounded(ss.pdist(d, "n_nationkey", "v"), 6)


@query("m_kmeans")
def kmeans(spark, sf):
    d = read(spark, sf, "customer").select("c_custkey", F.array("c_acctbal").alias("v"))
    return ss.kmeans(d, "c_custkey", "v", [[0.0], [5000.0], [9000.0]], 10)[0]


@query("m_auc", "with r as (select quality = 1 as y, rank() over (order by length(text)) + (count(*) over (partition by length(text)) - 1) / 2.0 as r from labels join documents using (doc_id)) select round((sum(r) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2.0) / (count(*) filter (y) * count(*) filter (not y)), 6) + 0.0 as auc from r")
def auc(spark, sf):
    d = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), "doc_id").withColumn("y", F.col("quality") == 1)
    return rounded(ss.auc(d, "y", "n"), 6)


@query("m_perfcurve", "with v as (select length(text) as s, count(*) filter (quality = 1) as p, count(*) filter (quality <> 1) as n from labels join documents using (doc_id) group by 1) select s::double as score, round(sum(n) over (order by s desc)::double / (select sum(n) from v), 6) + 0.0 as fpr, round(sum(p) over (order by s desc)::double / (select sum(p) from v), 6) + 0.0 as tpr from v")
def perfcurve(spark, sf):
    d = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), "doc_id").withColumn("y", F.col("quality") == 1)
    return rounded(ss.perfcurve(d, "y", "n"), 6)


@query("m_random")
def random_(spark, sf):
    return spark.range(1000).select("id", ss.rand(1).alias("u"), ss.randi(1, 6, 2).alias("i"), ss.normrnd(0, 1, 3).alias("n"), ss.exprnd(2, 4).alias("e"), ss.wblrnd(1, 2, 5).alias("w"), ss.gamrnd(2, 1, 6).alias("g"), ss.binornd(5, 0.5, 7).alias("b"), ss.trnd(4, 20).alias("t"))


@query("m_montecarlo_call")
def montecarlo(spark, sf):
    return ss.montecarlo_call(spark.range(1_000_000), 100, 100, 0.05, 0.2, 1.0, 1)


@query("st_windowed_events", "select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as end, event_type, count(*) as n, round(sum(value), 4) + 0.0 as total from events group by 1, 2, 3")
def windowed_events(spark, sf):
    d = ev.windowed(read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "value", ("event_type",))
    return rounded(d.drop("mean").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz")))


@query("c_json_props", "select event_id, (props::json ->> '$.page') as page from events")
def json_props(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"))


@query("c_jsonencode", "select '{\"n_name\":\"' || n_name || '\"}' as j from nation")
def jsonencode(spark, sf):
    return read(spark, sf, "nation").select(st.jsonencode(F.struct("n_name")).alias("j"))


@query("n_primes", "select n as p from range(2, 501) t(n) where not exists (select 1 from range(2, 23) q(k) where k < n and n % k = 0)")
def primes(spark, sf):
    from tabulon.operators import numeric

    return numeric.primes(spark, 500)


@query("n_spline_ppval", "select p_partkey, round(pow(p_size / 10.0::double, 3), 6) + 0.0 as y from part")
def spline_ppval(spark, sf):
    from tabulon.operators import numeric

    # A cubic is its own not-a-knot spline.
    b, c = numeric.spline([0, 1, 2, 3, 4, 5], [0, 1, 8, 27, 64, 125])
    return rounded(read(spark, sf, "part").select("p_partkey", numeric.ppval(b, c, F.col("p_size") / 10).alias("y")), 6)


@query("n_interp2", "select p_partkey, round((p_size / 10.0::double) * (p_partkey % 37 / 10.0::double), 6) + 0.0 as v from part where p_size <= 50")
def interp2(spark, sf):
    from tabulon.operators import numeric

    grid = spark.range(6).select(F.col("id").alias("x")).crossJoin(spark.range(6).select(F.col("id").alias("y"))).withColumn("v", F.col("x") * F.col("y"))
    q = read(spark, sf, "part").filter("p_size <= 50").select("p_partkey", (F.col("p_size") / 10).alias("x"), (F.col("p_partkey") % 37 / 10).alias("y"))
    return rounded(numeric.interp2(grid, q).select("p_partkey", "v"), 6)


@query("n_peaks", "select count(*) as n from range(0, 49) a, range(0, 49) b")
def peaks(spark, sf):
    from tabulon.operators import numeric

    return numeric.peaks(spark).agg(F.count("z").alias("n"))


@query("n_randperm", "select count(*) as n, sum(x) as s from range(1, 1001) t(x)")
def randperm(spark, sf):
    from tabulon.operators import numeric

    return numeric.randperm(spark, 1000).agg(F.countDistinct("value").alias("n"), F.sum("place").alias("s"))


@query("n_boundary", "select * from (values (1, 2), (1, 3), (2, 4), (3, 4)) t(a, b)")
def boundary(spark, sf):
    from tabulon.operators import numeric

    return numeric.delaunay_boundary(spark.createDataFrame([(1, 2, 3), (2, 3, 4)], "a int, b int, c int"))
