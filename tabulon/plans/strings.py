"""Queries for text, date and array functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import arrays as a
from tabulon.functions import dates as d
from tabulon.functions import strings as s

#: name: (Column, SQL) over part: k p_partkey, t p_name, b p_brand, z p_type, n p_size, v p_retailprice
TEXT: dict[str, tuple] = {
    "strcmp": (lambda: s.strcmp("b", "Brand#13"), "b = 'Brand#13'"),
    "strcmpi": (lambda: s.strcmpi("b", "BRAND#13"), "lower(b) = 'brand#13'"),
    "strncmp": (lambda: s.strncmp("b", "Brand#19", 7), "left(b, 7) = 'Brand#1'"),
    "strncmpi": (lambda: s.strncmpi("b", "BRAND#19", 7), "lower(left(b, 7)) = 'brand#1'"),
    "strlength": (lambda: s.strlength("t"), "length(t)::double"),
    "contains": (lambda: s.contains("z", "STEEL", "tin", ignore_case=True), "contains(lower(z), 'steel') or contains(lower(z), 'tin')"),
    "startsWith": (lambda: s.starts_with("b", "Brand#1", "Brand#2"), "starts_with(b, 'Brand#1') or starts_with(b, 'Brand#2')"),
    "endsWith": (lambda: s.ends_with("b", "1", "3"), "ends_with(b, '1') or ends_with(b, '3')"),
    "matches": (lambda: s.matches("b", "Brand#13", "Brand#21"), "b in ('Brand#13', 'Brand#21')"),
    "strfind": (lambda: F.array_join(s.strfind("t", "a"), ","), "array_to_string(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) = 'a'), ',')"),
    "append": (lambda: s.append("b", F.lit("-"), "z"), "b || '-' || z"),
    "strcat": (lambda: s.strcat(F.concat("b", F.lit("  ")), "z"), "b || z"),
    "reverse": (lambda: s.reverse("t"), "reverse(t)"),
    "deblank": (lambda: s.deblank(F.concat(F.lit(" "), "b", F.lit(" \t"))), "' ' || b"),
    "strtrim": (lambda: s.strtrim(F.concat(F.lit("\t "), "b", F.lit(" \n"))), "b"),
    "strip": (lambda: s.strip("b", "left", "Br"), "ltrim(b, 'Br')"),
    "pad": (lambda: s.pad("b", 12, "left", "*"), "lpad(b, 12, '*')"),
    "strjust": (lambda: s.strjust("b", 12, "left"), "rpad(b, 12, ' ')"),
    "lower": (lambda: s.lower("z"), "lower(z)"),
    "upper": (lambda: s.upper("t"), "upper(t)"),
    "replace": (lambda: s.replace("b", ("Brand", "B"), ("#", "-")), "replace(replace(b, 'Brand', 'B'), '#', '-')"),
    "strrep": (lambda: s.strrep("t", "a", "aa"), "replace(t, 'a', 'aa')"),
    "erase": (lambda: s.erase("b", "an", "#"), "replace(replace(b, 'an', ''), '#', '')"),
    "eraseURLs": (lambda: s.erase_urls(F.concat(F.lit("see http://x.y/z?q "), "b")), "'see  ' || b"),
    "erasePunctuation": (lambda: s.erase_punctuation("b"), "replace(b, '#', '')"),
    "split": (lambda: F.array_join(s.split("t", " "), "|"), "array_to_string(string_split(t, ' '), '|')"),
    "splitlines": (lambda: F.size(s.splitlines(F.concat("b", F.lit("\r\nx\ny")))), "3"),
    "join": (lambda: s.join(F.array("b", "z"), "/"), "b || '/' || z"),
    "strjoin": (lambda: s.strjoin(F.array("b", "z"), ""), "b || z"),
    "extractBefore": (lambda: s.extract_before("b", "#"), "left(b, instr(b, '#') - 1)"),
    "extractAfter": (lambda: s.extract_after("b", "#"), "substr(b, instr(b, '#') + 1)"),
    "extractBetween": (lambda: s.extract_between(F.concat(F.lit("<"), "b", F.lit(">")), "<", ">")[0], "b"),
    "eraseBetween": (lambda: s.erase_between("b", "B", "#"), "'B#' || substr(b, instr(b, '#') + 1)"),
    "replaceBetween": (lambda: s.replace_between("b", "B", "#", "x$1"), "'Bx$1#' || substr(b, instr(b, '#') + 1)"),
    "insertBefore": (lambda: s.insert_before("b", "#", "-"), "replace(b, '#', '-#')"),
    "insertAfter": (lambda: s.insert_after("b", 5, "-"), "left(b, 5) || '-' || substr(b, 6)"),
    "str2double": (lambda: s.str2double(F.concat(F.col("n").cast("string"), F.lit("d2"))), "n * 100.0::double"),
    "str2double_inf": (lambda: s.str2double(F.when(F.col("n") > 25, "-Inf").otherwise("abc")), "case when n > 25 then '-infinity'::double else 'nan'::double end"),
    "int2str": (lambda: s.int2str(F.col("n") / 4 - 5), "round(n / 4.0::double - 5)::bigint::varchar"),
    "num2str": (lambda: s.num2str("n"), "n::varchar"),
    "sprintf": (lambda: s.sprintf("%05d|%s", "n", "b"), "format('{:05d}|{}', n, b)"),
    "compose": (lambda: s.compose("%s-%d", "b", "n"), "b || '-' || n::varchar"),
    "string": (lambda: s.string("n"), "n::varchar"),
    "char": (lambda: s.char(F.array(F.col("n") + 64, F.lit(98))), "chr((n + 64)::int) || 'b'"),
    "cellstr": (lambda: F.array_join(s.cellstr(F.array(F.concat("b", F.lit(" ")), "z")), "|"), "b || '|' || z"),
    "unicode2native": (lambda: F.hex(s.unicode2native("b")), "hex(encode(b))"),
    "genvarname": (lambda: s.valid_name("b"), "replace(b, '#', '_')"),
    "regexp_match": (lambda: F.array_join(s.regexp("z", "[A-Z]{5}"), ","), "array_to_string(regexp_extract_all(z, '[A-Z]{5}'), ',')"),
    "regexp_tokens": (lambda: F.array_join(s.regexp("b", "#(\\d)", "tokens"), ","), "array_to_string(regexp_extract_all(b, '#(\\d)', 1), ',')"),
    "regexp_start": (lambda: F.array_join(s.regexp("b", "#", "start"), ","), "instr(b, '#')::varchar"),
    "regexp_split": (lambda: F.array_join(s.regexp("t", "\\s+", "split"), "|"), "array_to_string(regexp_split_to_array(t, '\\s+'), '|')"),
    "regexpi": (lambda: s.regexpi("b", "BRAND", "has"), "true"),
    "regexprep": (lambda: s.regexprep("b", "([a-z]+)#", "<$1>"), "regexp_replace(b, '([a-z]+)#', '<\\1>', 'g')"),
    "named_tokens": (lambda: s.named_tokens("b", "(?<word>[A-Za-z]+)#(?<num>[0-9]+)")["num"], "substr(b, instr(b, '#') + 1)"),
    "urlencode": (lambda: s.urlencode("b"), "replace(b, '#', '%23')"),
    "urldecode": (lambda: s.urldecode(s.urlencode("b")), "b"),
    "fullfile": (lambda: s.fullfile(F.lit("a/"), "b", F.lit("c.txt")), "'a/' || b || '/c.txt'"),
    "jsondecode": (lambda: s.jsondecode(F.concat(F.lit('{"q":'), F.col("n").cast("string"), F.lit("}")), "q int")["q"], "n::int"),
    "jsonencode": (lambda: s.jsonencode(F.struct("b")), "'{\"b\":\"' || b || '\"}'"),
}

#: name: (Column, SQL) over orders: k o_orderkey, t o_orderdate
DATES: dict[str, tuple] = {
    "year": (lambda: d.year("t"), "year(t)::int"),
    "month": (lambda: d.month("t"), "month(t)::int"),
    "day": (lambda: d.day("t"), "day(t)::int"),
    "hour": (lambda: d.hour("t"), "hour(t)::int"),
    "minute": (lambda: d.minute("t"), "minute(t)::int"),
    "second": (lambda: d.second("t"), "second(t)::double"),
    "quarter": (lambda: d.quarter("t"), "quarter(t)::int"),
    "weekday": (lambda: d.weekday("t"), "(dayofweek(t) + 1)::int"),
    "datetime": (lambda: d.datetime(d.year("t"), d.month("t"), d.day("t")), "make_timestamp(year(t), month(t), day(t), 0, 0, 0)"),
    "datenum": (lambda: F.round(d.datenum("t"), 6), "round(date_diff('day', date '1970-01-01', t::date) + 719529 + (hour(t) * 3600 + minute(t) * 60 + second(t)) / 86400.0, 6)::double"),
    "datestr": (lambda: d.datestr("t", "yyyy/MM/dd"), "strftime(t, '%Y/%m/%d')"),
    "datevec": (lambda: F.array_join(F.transform(d.datevec("t"), lambda x: x.cast("int").cast("string")), "-"), "concat_ws('-', year(t), month(t), day(t), hour(t), minute(t), second(t))"),
    "dateshift_start": (lambda: d.dateshift("t", "start", "month").cast("date"), "date_trunc('month', t)::date"),
    "dateshift_end": (lambda: d.dateshift("t", "end", "month").cast("date"), "last_day(t)"),
    "calmonths": (lambda: d.calmonths("t", 1), "t + interval 1 month"),
    "calyears": (lambda: d.calyears("t", 1), "t + interval 1 year"),
    "isbetween": (lambda: d.isbetween("t", "1995-01-01", "1996-01-01", "openright"), "t >= timestamp '1995-01-01' and t < timestamp '1996-01-01'"),
    "isbusday": (lambda: d.isbusday("t"), "dayofweek(t) between 1 and 5"),
    "fbusdate": (lambda: d.fbusdate(d.year("t"), d.month("t")), "(date_trunc('month', t)::date + case dayofweek(date_trunc('month', t)) when 0 then 1 when 6 then 2 else 0 end)::date"),
    "lbusdate": (lambda: d.lbusdate(d.year("t"), d.month("t")), "(last_day(t) - case dayofweek(last_day(t)) when 0 then 2 when 6 then 1 else 0 end)::date"),
    "elapsed": (lambda: d.elapsed(F.lit("1992-01-01").cast("timestamp_ntz"), "t", "days"), "date_diff('second', timestamp '1992-01-01', t) / 86400.0::double"),
    "duration": (lambda: d.seconds(d.duration(F.lit(1), d.day("t"), 5)), "3605 + 60.0::double * day(t)"),
}

#: name: (Column of one number or text, SQL) over embeddings: k vec_id, e embedding, n vec_id % 7
ARRAYS: dict[str, tuple] = {
    "colon": (lambda: F.array_join(F.transform(a.colon(0, 1, "n"), lambda x: x.cast("int").cast("string")), ","), "array_to_string(range(0, n + 1), ',')"),
    "linspace": (lambda: F.round(a._sum(a.linspace(0, "n", 5)), 9), "n * 2.5::double"),
    "logspace": (lambda: F.round(a._sum(a.logspace(0, 2, 3)), 6), "111.0::double"),
    "fill": (lambda: F.size(a.fill("n", 4)), "4"),
    "zeros": (lambda: a._sum(a.zeros(3)), "0.0::double"),
    "ones": (lambda: a._sum(a.ones(3)), "3.0::double"),
    "true": (lambda: a.true_(2)[0], "true"),
    "false": (lambda: a.false_(2)[0], "false"),
    "flip": (lambda: a.flip("e")[0].cast("double"), "e[64]::double"),
    "circshift": (lambda: a.circshift("e", 3)[0].cast("double"), "e[62]::double"),
    "repmat": (lambda: F.size(a.repmat("e", 3)), "len(e) * 3"),
    "repelem": (lambda: a.repelem("e", 2)[3].cast("double"), "e[2]::double"),
    "horzcat_arrays": (lambda: F.size(a.horzcat("e", "e")), "2 * len(e)"),
    "reshape_array": (lambda: a.reshape("e", 8)[2][1].cast("double"), "e[18]::double"),
    "numel": (lambda: a.numel("e"), "len(e)"),
    "isempty": (lambda: a.isempty("e"), "len(e) = 0"),
    "isscalar": (lambda: a.isscalar("e"), "len(e) = 1"),
    "isrow": (lambda: a.isrow("e"), "true"),
    "iscolumn": (lambda: a.iscolumn("e"), "len(e) = 1"),
    "isvector": (lambda: a.isvector("e"), "len(e) >= 1"),
    "ismatrix": (lambda: a.ismatrix("e"), "true"),
    "ndims": (lambda: a.ndims("e"), "2"),
    "permute": (lambda: a.permute(a.reshape("e", 8), [2, 1])[1][2].cast("double"), "e[18]::double"),
    "ipermute": (lambda: a.ipermute(a.permute(a.reshape("e", 8), [2, 1]), [2, 1])[2][1].cast("double"), "e[18]::double"),
    "squeeze": (lambda: a.squeeze(F.array(a.reshape("e", 8)))[2][1].cast("double"), "e[18]::double"),
    "find": (lambda: F.size(a.find(F.transform("e", lambda x: F.when(x > 0, 1).otherwise(0)))), "len(list_filter(e, lambda x: x > 0))"),
    "ind2sub": (lambda: a.ind2sub(F.col("k") + 1, 5)["column"], "k // 5 + 1"),
    "sub2ind": (lambda: a.sub2ind("n", F.col("n") + 1, 10), "n * 10 + n"),
    "padsequences": (lambda: F.size(a.padsequences("e", 70)), "70"),
    "num2cell": (lambda: F.size(a.num2cell("e")), "len(e)"),
    "cell2mat": (lambda: F.size(a.cell2mat(a.num2cell("e"))), "len(e)"),
    "mat2cell": (lambda: F.size(a.mat2cell("e", [10, 54])[1]), "54"),
    "dot": (lambda: F.round(a.dot("e", "e"), 6), "round(list_sum(list_transform(e, lambda x: x::double * x)), 6)"),
    "norm": (lambda: F.round(a.norm("e"), 6), "round(sqrt(list_sum(list_transform(e, lambda x: x::double * x))), 6)"),
    "norm_1": (lambda: F.round(a.norm("e", 1), 6), "round(list_sum(list_transform(e, lambda x: abs(x::double))), 6)"),
    "norm_inf": (lambda: F.round(a.norm("e", float("inf")), 6), "round(list_max(list_transform(e, lambda x: abs(x::double))), 6)"),
    "cross": (lambda: F.round(a.cross("e", a.flip("e"))[0], 7), "round(e[2]::double * e[62]::double - e[3]::double * e[63]::double, 7)"),
    "cosine": (lambda: F.round(a.cosine("e", a.flip("e")), 6), "round(list_cosine_similarity(list_transform(e, lambda x: x::double), list_reverse(list_transform(e, lambda x: x::double))), 6)"),
    "distance": (lambda: F.round(a.distance("e", a.flip("e")), 6), "round(list_distance(list_transform(e, lambda x: x::double), list_reverse(list_transform(e, lambda x: x::double))), 6)"),
    "conv": (lambda: F.array_join(F.transform(a.conv(F.array(F.lit(1.0), F.col("n").cast("double")), F.array(F.lit(1.0), F.lit(2.0))), lambda x: x.cast("int").cast("string")), ","), "'1,' || (n + 2) || ',' || (2 * n)"),
    "polyval": (lambda: a.polyval(F.array(F.lit(1.0), F.lit(-2.0), F.lit(3.0)), "n"), "n * n - 2.0::double * n + 3"),
    "polyder": (lambda: a.polyval(a.polyder(F.array(F.lit(1.0), F.lit(-2.0), F.lit(3.0))), "n"), "2.0::double * n - 2"),
    "polyint": (lambda: a.polyval(a.polyint(F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0))), "n"), "n * n * n + n * n + n::double"),
    "cumsum_array": (lambda: F.round(a.cumsum("e")[63], 6), "round(list_sum(list_transform(e, lambda x: x::double)), 6)"),
    "hamming": (lambda: F.round(a.hamming(5)[0], 9), "0.08::double"),
    "hann": (lambda: F.round(a.hann(5)[2], 9), "1.0::double"),
    "blackman": (lambda: F.round(a.blackman(5)[2], 9), "1.0::double"),
    "fftshift": (lambda: a.fftshift("e")[0].cast("double"), "e[33]::double"),
    "ifftshift": (lambda: a.ifftshift(a.fftshift("e"))[5].cast("double"), "e[6]::double"),
    "de2bi": (lambda: F.array_join(F.transform(a.de2bi("n", 3), lambda x: x.cast("string")), ""), "(n & 1)::varchar || ((n >> 1) & 1)::varchar || ((n >> 2) & 1)::varchar"),
    "bi2de": (lambda: a.bi2de(a.de2bi("n", 8)), "n"),
    "pskmod": (lambda: F.round(a.pskmod("n", 4)["re"], 9) + 0.0, "round(cos(pi() * n / 2), 9) + 0.0::double"),
    "qammod": (lambda: F.pow(a.qammod("n", 16)["re"], F.lit(2.0)), "case when n in (4, 5, 6) then 1.0::double else 9.0::double end"),
}


def _query(table: str, columns: dict[str, str], build):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        src = spark.read.parquet(f"{sf}/{table}.parquet").select(*[F.expr(e).alias(n) for n, e in columns.items()])
        return src.select("k", build().alias("r"))

    return run


_SOURCES = {
    "part": {"k": "p_partkey", "t": "p_name", "b": "p_brand", "z": "p_type", "n": "cast(p_size as bigint)"},
    "orders": {"k": "o_orderkey", "t": "o_orderdate"},
    "embeddings": {"k": "vec_id", "e": "embedding", "n": "vec_id % 7"},
}
QUERIES, SQL = {}, {}
for _table, _defs in (("part", TEXT), ("orders", DATES), ("embeddings", ARRAYS)):
    _cols = ", ".join(f"{e} as {n}" for n, e in _SOURCES[_table].items())
    for _name, (_build, _e) in _defs.items():
        QUERIES[f"fn_{_name}"] = _query(_table, _SOURCES[_table], _build)
        SQL[f"fn_{_name}"] = f"with d as (select {_cols} from {_table}) select k, ({_e}) as r from d"
