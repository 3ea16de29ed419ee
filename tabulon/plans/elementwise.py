"""Queries for elementwise functions, each with its SQL, over numbers with NaN, Inf, zeros and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import elementwise as m
from tabulon.functions import special as s

NAN, INF = "'nan'::double", "'infinity'::double"

#: k: key; x: halves and tenths from -2.4 to 2.5, NaN, Inf, -Inf; y: whole numbers from -6 to 6; n, p: whole.
D_SQL = f"""with d as (select p_partkey as k,
  case when p_partkey % 97 = 0 then {NAN} when p_partkey % 101 = 0 then {INF} when p_partkey % 103 = 0 then -{INF} else (p_size - 25) / 10.0::double end as x,
  ((p_partkey % 13) - 6)::double as y, p_size::bigint as n, p_partkey::bigint as p, p_retailprice as v from part)"""


def numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey")
    x = F.when(k % 97 == 0, F.lit(float("nan"))).when(k % 101 == 0, F.lit(float("inf"))).when(k % 103 == 0, F.lit(float("-inf"))).otherwise((F.col("p_size") - 25) / 10.0)
    return d.select(k.alias("k"), x.alias("x"), ((k % 13) - 6).cast("double").alias("y"), F.col("p_size").cast("bigint").alias("n"), k.cast("bigint").alias("p"), F.col("p_retailprice").alias("v"))


def fin(e: str, other: str = NAN) -> str:
    return f"case when isfinite(x) then {e} else {other} end"


def inside(e: str, cond: str) -> str:
    return f"case when not isnan(x) and {cond} then {e} else {NAN} end"


_BOTH = "not isnan(x) and not isnan(y)"
_DIV = f"case when y = 0 then case when isnan(x) or x = 0 then {NAN} when x > 0 then {INF} else -{INF} end else x / y end"
_MOD = f"case when isnan(x) or isinf(x) or y = 0 then {NAN} else x - floor(x / nullif(y, 0)) * y end"
_REM = f"case when isnan(x) or isinf(x) or y = 0 then {NAN} else x - trunc(x / nullif(y, 0)) * y end"

_LIN = "(case when n / 50.0::double <= 0.04045 then n / 50.0::double / 12.92 else pow((n / 50.0::double + 0.055) / 1.055, 2.4) end * 1.0000001)"
_LAB = f"case when {_LIN} > pow(6 / 29.0::double, 3) then 116 * pow({_LIN}, 1 / 3.0::double) - 16 else 116 / (3 * pow(6 / 29.0::double, 2)) * {_LIN} end"

#: name: (Column builder, SQL expression, decimals or None for exact values)
TABLE: dict[str, tuple] = {
    "plus": (lambda: m.plus("x", "y"), "x + y", 9),
    "minus": (lambda: m.minus("x", "y"), "x - y", 9),
    "times": (lambda: m.times("x", "y"), "x * y", 9),
    "rdivide": (lambda: m.rdivide("x", "y"), _DIV, 9),
    "ldivide": (lambda: m.ldivide("y", "x"), _DIV, 9),
    "power": (lambda: m.power(m.abs_("x"), "y"), "pow(abs(x), y)", 6),
    "uminus": (lambda: m.uminus("x"), "-x", 9),
    "uplus": (lambda: m.uplus("x"), "x", 9),
    "mod": (lambda: m.mod("x", "y"), _MOD, 9),
    "rem": (lambda: m.rem("x", "y"), _REM, 9),
    "idivide": (lambda: m.idivide("p", "n", "fix"), "case when n = 0 then 9223372036854775807 else p // nullif(n, 0) end", None),
    "idivide_round": (lambda: m.idivide("p", "n", "round"), "case when n = 0 then 9223372036854775807 else (2 * p + n) // nullif(2 * n, 0) end", None),
    "eq": (lambda: m.eq("x", "y"), f"x = y and {_BOTH}", None),
    "ne": (lambda: m.ne("x", "y"), f"not (x = y and {_BOTH})", None),
    "lt": (lambda: m.lt("x", "y"), f"x < y and {_BOTH}", None),
    "le": (lambda: m.le("x", "y"), f"x <= y and {_BOTH}", None),
    "gt": (lambda: m.gt("x", "y"), f"x > y and {_BOTH}", None),
    "ge": (lambda: m.ge("x", "y"), f"x >= y and {_BOTH}", None),
    "logical": (lambda: m.logical("x"), "x <> 0", None),
    "and": (lambda: m.and_("x", "y"), "x <> 0 and y <> 0", None),
    "or": (lambda: m.or_("x", "y"), "x <> 0 or y <> 0", None),
    "not": (lambda: m.not_("x"), "x = 0", None),
    "xor": (lambda: m.xor("x", "y"), "(x <> 0) <> (y <> 0)", None),
    "isnan": (lambda: m.isnan("x"), "isnan(x)", None),
    "isinf": (lambda: m.isinf("x"), "isinf(x)", None),
    "isfinite": (lambda: m.isfinite("x"), "isfinite(x)", None),
    "bitand": (lambda: m.bitand("p", "n"), "p & n", None),
    "bitor": (lambda: m.bitor("p", "n"), "p | n", None),
    "bitxor": (lambda: m.bitxor("p", "n"), "xor(p, n)", None),
    "bitshift": (lambda: m.bitshift("p", 3), "p << 3", None),
    "bitshift_right": (lambda: m.bitshift("p", -2), "p >> 2", None),
    "swapbytes": (lambda: m.swapbytes("p", 32), "((p & 255) << 24) | ((p & 65280) << 8) | ((p >> 8) & 65280) | ((p >> 24) & 255)", None),
    "int8": (lambda: m.integer(F.col("x") * 100, "int8"), fin("least(127, greatest(-128, round(x * 100)))", "case when isnan(x) then 0 when x > 0 then 127 else -128 end"), "int"),
    "int16": (lambda: m.integer(F.col("x") * 100000, "int16"), fin("least(32767, greatest(-32768, round(x * 100000)))", "case when isnan(x) then 0 when x > 0 then 32767 else -32768 end"), "int"),
    "int32": (lambda: m.integer(F.col("x") * 1e9, "int32"), fin("least(2147483647, greatest(-2147483648, round(x * 1e9)))", "case when isnan(x) then 0 when x > 0 then 2147483647 else -2147483648 end"), "int"),
    "int64": (lambda: m.integer(F.col("x") * 1e6, "int64"), fin("round(x * 1e6)::bigint", "case when isnan(x) then 0 when x > 0 then 9223372036854775807 else -9223372036854775808 end"), "int"),
    "uint8": (lambda: m.integer(F.col("x") * 200, "uint8"), fin("least(255, greatest(0, round(x * 200)))", "case when isnan(x) then 0 when x > 0 then 255 else 0 end"), "int"),
    "uint16": (lambda: m.integer(F.col("x") * 50000, "uint16"), fin("least(65535, greatest(0, round(x * 50000)))", "case when isnan(x) then 0 when x > 0 then 65535 else 0 end"), "int"),
    "uint32": (lambda: m.integer(F.col("x") * 4e9, "uint32"), fin("least(4294967295, greatest(0, round(x * 4e9)))", "case when isnan(x) then 0 when x > 0 then 4294967295 else 0 end"), "int"),
    "uint64": (lambda: m.integer(F.when(F.isnan("x") | (F.abs("x") > 1e9), 0).otherwise(F.col("x")) * 1e6, "uint64").cast("bigint"), fin("greatest(0, round(x * 1e6))", "0"), "int"),
    "single": (lambda: m.single(F.when(m.isfinite("x"), F.col("x")).otherwise(0.0)).cast("double"), fin("x::float::double", "0"), 9),
    "double": (lambda: m.double("n"), "n::double", None),
    "floor": (lambda: m.floor("x"), fin("floor(x)", "x"), 1),
    "ceil": (lambda: m.ceil("x"), fin("ceil(x)", "x"), 1),
    "fix": (lambda: m.fix("x"), fin("trunc(x)", "x"), 1),
    "round": (lambda: m.round_("x"), fin("round(x)", "x"), 1),
    "round_significant": (lambda: m.round_significant("v", 2), "case when v = 0 then v else round(v / pow(10, floor(log10(abs(v))) - 1)) * pow(10, floor(log10(abs(v))) - 1) end", 6),
    "abs": (lambda: m.abs_("x"), "abs(x)", None),
    "sign": (lambda: m.sign("x"), f"case when isnan(x) then {NAN} else sign(x)::double end", None),
    "exp": (lambda: m.exp("x"), "exp(x)", 9),
    "expm1": (lambda: m.expm1("x"), "exp(x) - 1", 9),
    "log": (lambda: m.log("x"), f"case when isnan(x) or x < 0 then {NAN} when x = 0 then -{INF} else ln(x) end", 9),
    "log10": (lambda: m.log10("x"), f"case when isnan(x) or x < 0 then {NAN} when x = 0 then -{INF} else log10(x) end", 9),
    "log2": (lambda: m.log2("x"), f"case when isnan(x) or x < 0 then {NAN} when x = 0 then -{INF} else log2(x) end", 9),
    "log1p": (lambda: m.log1p("x"), f"case when isnan(x) or x < -1 then {NAN} when x = -1 then -{INF} else ln(1 + x) end", 9),
    "sqrt": (lambda: m.sqrt("x"), inside("sqrt(x)", "x >= 0"), 9),
    "realsqrt": (lambda: m.realsqrt(m.abs_("x")), f"case when isnan(x) then {NAN} else sqrt(abs(x)) end", 9),
    "hypot": (lambda: m.hypot("x", "y"), f"case when isinf(x) then {INF} else sqrt(x * x + y * y) end", 9),
    "pow2": (lambda: m.pow2("x"), "pow(2, x)", 9),
    "nextpow2": (lambda: m.nextpow2("n"), "case when n = 0 then 0 else ceil(log2(n) - 1e-12) end", 1),
    "heaviside": (lambda: m.heaviside("x"), "case when isnan(x) then x when x < 0 then 0 when x = 0 then 0.5 else 1 end", None),
    "sin": (lambda: m.sin("x"), fin("sin(x)"), 9),
    "cos": (lambda: m.cos("x"), fin("cos(x)"), 9),
    "tan": (lambda: m.tan("x"), fin("tan(x)"), 7),
    "asin": (lambda: m.asin("x"), inside("asin(x)", "abs(x) <= 1"), 9),
    "acos": (lambda: m.acos("x"), inside("acos(x)", "abs(x) <= 1"), 9),
    "atan": (lambda: m.atan("x"), "atan(x)", 9),
    "atan2": (lambda: m.atan2("y", "x"), "atan2(y, x)", 9),
    "sinh": (lambda: m.sinh("x"), "sinh(x)", 9),
    "cosh": (lambda: m.cosh("x"), "cosh(x)", 9),
    "tanh": (lambda: m.tanh("x"), "tanh(x)", 9),
    "asinh": (lambda: m.asinh("x"), fin("asinh(x)", "x"), 9),
    "acosh": (lambda: m.acosh("x"), inside("acosh(x)", "x >= 1"), 9),
    "atanh": (lambda: m.atanh(F.col("x") / 2.5), f"case when isnan(x) or abs(x / 2.5) > 1 then {NAN} when abs(x / 2.5) = 1 then sign(x) * {INF} else atanh(x / 2.5) end", 9),
    "sind": (lambda: m.sind(F.col("y") * 45), "sin(radians(y * 45))", 9),
    "cosd": (lambda: m.cosd(F.col("y") * 45), "cos(radians(y * 45))", 9),
    "tand": (lambda: m.tand(F.col("y") * 45), f"case when abs(y) % 4 = 0 then 0 when abs(y) % 2 = 1 then tan(radians(y * 45)) when y in (-6, 2, 6 - 4) then {INF} when y in (-2, 6) then -{INF} else 0 end", 9),
    "sinpi": (lambda: m.sinpi(F.col("y") / 4), "sin(pi() * y / 4)", 9),
    "cospi": (lambda: m.cospi(F.col("y") / 4), "cos(pi() * y / 4)", 9),
    "deg2rad": (lambda: m.deg2rad("y"), "radians(y)", 9),
    "rad2deg": (lambda: m.rad2deg("y"), "degrees(y)", 9),
    "pol2cart": (lambda: m.pol2cart("y", "v")["x"], "v * cos(y)", 6),
    "cart2pol": (lambda: m.cart2pol("y", "v")["theta"], "atan2(v, y)", 9),
    "factorial": (lambda: m.factorial(F.col("n") % 15), "factorial((n % 15)::int)::double", None),
    "gcd": (lambda: m.gcd("p", "n"), "gcd(p, n)", None),
    "lcm": (lambda: m.lcm("p", "n"), "lcm(p, n)", None),
    "intmax": (lambda: m.intmax("int32"), "2147483647", "int"),
    "intmin": (lambda: m.intmin("int32"), "-2147483648", "int"),
    "realmax": (lambda: m.realmax(), "1.7976931348623157e308::double", None),
    "realmin": (lambda: m.realmin(), "2.2250738585072014e-308::double", None),
    "flintmax": (lambda: m.flintmax(), "9007199254740992::double", None),
    "complex_abs": (lambda: m.modulus(m.complex_("y", "n")), "sqrt(y * y + n * n)", 9),
    "angle": (lambda: m.angle(m.complex_("y", "n")), "atan2(n, y)", 9),
    "real": (lambda: m.real(m.complex_("y", "n")), "y", None),
    "imag": (lambda: m.imag(m.complex_("y", "n")), "n::double", None),
    "conj": (lambda: m.imag(m.conj(m.complex_("y", "n"))), "-n::double", None),
    "csqrt": (lambda: m.imag(m.csqrt("y")), "case when y < 0 then sqrt(-y) else 0 end", 9),
    "clog": (lambda: m.imag(m.clog("y")), "case when y < 0 then pi() else 0 end", 9),
    "sinc": (lambda: m.sinc(F.col("y") / 3), "case when y = 0 then 1 else sin(pi() * y / 3) / (pi() * y / 3) end", 9),
    "square": (lambda: m.square(F.col("y") + 0.1), "case when (y + 0.1) - floor((y + 0.1) / (2 * pi())) * 2 * pi() < pi() then 1.0 else -1.0 end", 9),
    "sawtooth": (lambda: m.sawtooth(F.col("y") + 0.1), "2 * ((y + 0.1) / (2 * pi()) - floor((y + 0.1) / (2 * pi()))) - 1", 9),
    "rectpuls": (lambda: m.rectpuls("y", 4), "case when y >= -2 and y < 2 then 1.0 else 0.0 end", None),
    "tripuls": (lambda: m.tripuls("y", 8), "greatest(0, 1 - abs(2 * y / 8))", 9),
    "gauspuls": (lambda: m.gauspuls(F.col("y") / 1000), "exp(pow(pi() * 1000 * 0.5, 2) / (4 * ln(pow(10, -0.3))) * pow(y / 1000, 2)) * cos(2 * pi() * y)", 9),
    "db": (lambda: m.db("n"), f"case when n = 0 then -{INF} else 20 * log10(n) end", 9),
    "im2double": (lambda: m.im2double("n"), "n / 255.0::double", 9),
    "im2uint8": (lambda: m.im2uint8(F.col("n") / 50.0), "round(n / 50.0::double * 255)", "int"),
    "im2uint16": (lambda: m.im2uint16(F.col("n") / 50.0), "round(n / 50.0::double * 65535)", "int"),
    "rgb2gray": (lambda: m.rgb2gray("n", "y", "v"), "0.2989 * n + 0.5870 * y + 0.1140 * v", 6),
    "gray2rgb": (lambda: m.gray2rgb("n")[2], "n", None),
    "rgb2hsv": (lambda: m.rgb2hsv(F.col("n") / 50, F.lit(0.25), F.lit(0.5))["s"], "(greatest(n / 50.0::double, 0.5) - least(n / 50.0::double, 0.25)) / greatest(n / 50.0::double, 0.5)", 9),
    "hsv2rgb": (lambda: m.hsv2rgb(F.col("n") / 51, 0.5, 0.8)["r"], "0.8 - 0.4 * greatest(0, least((5 + n / 51.0::double * 6) % 6, 4 - (5 + n / 51.0::double * 6) % 6, 1))", 9),
    "rgb2lab": (lambda: m.rgb2lab(*[F.col("n") / 50] * 3)["L"], _LAB, 4),
    "lab2rgb": (lambda: m.lab2rgb(F.col("n") + 30, 0.0, 0.0)["g"], "1.055 * pow(pow((n + 46) / 116.0::double, 3), 1 / 2.4::double) - 0.055", 3),
    "gamma": (lambda: s.gamma(F.col("n") / 5 + 0.5), "gamma(n / 5.0::double + 0.5)", 3),
    "gammaln": (lambda: s.gammaln(F.col("n") + 0.5), "lgamma(n::double + 0.5)", 7),
    "normpdf": (lambda: s.normpdf("y"), "exp(-y * y / 2) / sqrt(2 * pi())", 9),
    "tpdf": (lambda: s.tpdf("y", 1), "1 / (pi() * (1 + y * y))", 9),
    "tcdf": (lambda: s.tcdf("y", 1), "0.5 + atan(y) / pi()", 9),
    "tinv": (lambda: s.tinv(F.col("n") / 51, 1), "tan(pi() * (n / 51.0::double - 0.5))", 6),
    "chi2cdf": (lambda: s.chi2cdf("n", 2), "1 - exp(-n / 2.0::double)", 9),
    "wblinv": (lambda: s.wblinv(F.col("n") / 51, 2, 3), "2 * pow(-ln(1 - n / 51.0::double), 1 / 3.0::double)", 9),
}

#: Without SQL for the function itself: an identity that it must meet, and the SQL of that.
IDENTITIES: dict[str, tuple] = {
    "erf": (lambda: s.erf("y") + s.erfc("y"), "1.0::double", 9),
    "erfinv": (lambda: s.erfinv(s.erf(F.col("y") / 3)), "y / 3", 7),
    "erfcinv": (lambda: s.erfcinv(s.erfc(F.col("y") / 3)), "y / 3", 7),
    "normcdf": (lambda: s.normcdf("y") + s.normcdf(-F.col("y")), "1.0::double", 9),
    "norminv": (lambda: s.normcdf(s.norminv(F.col("n") / 51)), "n / 51.0::double", 8),
    "binocdf": (lambda: s.binocdf(F.col("n") % 4, 3, 0.5), "case (n % 4) when 0 then 0.125 when 1 then 0.5 when 2 then 0.875 else 1 end", 9),
    "blsprice": (lambda: s.blsprice(100.0, F.col("n") + 60, 0.05, 1.0, 0.2)["call"] - s.blsprice(100.0, F.col("n") + 60, 0.05, 1.0, 0.2)["put"], "100 - (n + 60) * exp(-0.05)", 6),
}


def _query(build, digits):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c: Column = build()
        if digits == "int":
            c = c.cast("bigint")
        elif digits is not None:
            c = F.round(c, digits) + 0.0
        return numbers(spark, sf).select("k", c.alias("r"))

    return run


def _sql(e: str, digits) -> str:
    r = f"({e})::bigint" if digits == "int" else f"({e})" if digits is None else f"round(({e})::double, {digits}) + 0.0::double"
    return f"{D_SQL} select k, {r} as r from d"


QUERIES = {f"fn_{n}": _query(b, d) for n, (b, _, d) in (TABLE | IDENTITIES).items()}
SQL = {f"fn_{n}": _sql(e, d) for n, (_, e, d) in (TABLE | IDENTITIES).items()}
