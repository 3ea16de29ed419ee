"""Elementwise math with array-language rules: IEEE division, NaN unequal to all, saturating integers.

Every function takes Columns, column names or numbers and returns a Column of built-in expressions,
so it stays inside whole-stage code generation.  Numeric missing is NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def col(x) -> Column:
    """A Column as it is, a string as a column name, anything else as a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def num(x) -> Column:
    """A double in which NULL is NaN."""
    return F.coalesce(col(x).cast("double"), F.lit(NAN))


def _nan(*xs: Column) -> Column:
    out = F.isnan(xs[0])
    for x in xs[1:]:
        out = out | F.isnan(x)
    return out


# Arithmetic --------------------------------------------------------------------------------------


def plus(a, b) -> Column:
    return num(a) + num(b)


def minus(a, b) -> Column:
    return num(a) - num(b)


def times(a, b) -> Column:
    return num(a) * num(b)


def rdivide(a, b) -> Column:
    """IEEE division: 1/0 is Inf, 0/0 is NaN, and the sign of zero counts."""
    a, b = num(a), num(b)
    # A negative zero is told by its text.
    minus0 = b.cast("string").startswith("-")
    at0 = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a > 0) != minus0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, at0).otherwise(a / F.when(b != 0, b))


def ldivide(a, b) -> Column:
    return rdivide(b, a)


def power(a, b) -> Column:
    return F.pow(num(a), num(b))


def uminus(a) -> Column:
    return -num(a)


def uplus(a) -> Column:
    return num(a)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def mod(a, b) -> Column:
    """Remainder with the sign of the divisor; NaN for a zero divisor."""
    a, b = num(a), num(b)
    safe = F.when((b != 0) & finite(b), b)
    body = a - F.floor(F.when(finite(a), a) / safe).cast("double") * safe
    same = F.when((a == 0) | ((a > 0) == (b > 0)), a).otherwise(b)
    return F.when(_nan(a, b) | ~finite(a) | (b == 0), F.lit(NAN)).when(~finite(b), same).otherwise(body)


def rem(a, b) -> Column:
    """Remainder with the sign of the dividend; NaN for a zero divisor, the dividend for an infinite one."""
    a, b = num(a), num(b)
    safe = F.when((b != 0) & finite(b), b)
    return F.when(_nan(a, b) | ~finite(a) | (b == 0), F.lit(NAN)).when(~finite(b), a).otherwise(a % safe)


def idivide(a, b, how: str = "fix") -> Column:
    """Integer division of bigints, rounded by fix, floor, ceil or round; a zero divisor saturates."""
    a, b = col(a).cast("bigint"), col(b).cast("bigint")
    safe = F.when(b != 0, b)
    q = F.call_function("div", a, safe)
    r = a - q * safe
    up = F.when(r == 0, 0).when((r > 0) == (safe > 0), 1).otherwise(-1)
    out = {
        "fix": q,
        "floor": q - F.when(up < 0, 1).otherwise(0),
        "ceil": q + F.when(up > 0, 1).otherwise(0),
        "round": q + F.when(2 * F.abs(r) >= F.abs(safe), up).otherwise(0),
    }[how]
    top = F.when(a > 0, F.lit(2**63 - 1)).when(a < 0, F.lit(-(2**63))).otherwise(F.lit(0))
    return F.when(b == 0, top).otherwise(out)


# Comparison and logic ----------------------------------------------------------------------------


def eq(a, b) -> Column:
    a, b = num(a), num(b)
    return (a == b) & ~_nan(a, b)


def ne(a, b) -> Column:
    return ~eq(a, b)


def lt(a, b) -> Column:
    a, b = num(a), num(b)
    return (a < b) & ~_nan(a, b)


def le(a, b) -> Column:
    a, b = num(a), num(b)
    return (a <= b) & ~_nan(a, b)


def gt(a, b) -> Column:
    a, b = num(a), num(b)
    return (a > b) & ~_nan(a, b)


def ge(a, b) -> Column:
    a, b = num(a), num(b)
    return (a >= b) & ~_nan(a, b)


def logical(x) -> Column:
    """Nonzero is true; NaN is true."""
    return num(x) != 0


def and_(a, b) -> Column:
    return logical(a) & logical(b)


def or_(a, b) -> Column:
    return logical(a) | logical(b)


def not_(a) -> Column:
    return ~logical(a)


def xor(a, b) -> Column:
    return logical(a) != logical(b)


def isnan(x) -> Column:
    return F.isnan(num(x))


def isinf(x) -> Column:
    return F.abs(num(x)) == F.lit(INF)


def isfinite(x) -> Column:
    return finite(num(x))


def bitand(a, b) -> Column:
    return col(a).cast("bigint").bitwiseAND(col(b).cast("bigint"))


def bitor(a, b) -> Column:
    return col(a).cast("bigint").bitwiseOR(col(b).cast("bigint"))


def bitxor(a, b) -> Column:
    return col(a).cast("bigint").bitwiseXOR(col(b).cast("bigint"))


def bitshift(a, k: int) -> Column:
    a = col(a).cast("bigint")
    return F.shiftleft(a, k) if k >= 0 else F.shiftrightunsigned(a, -k)


def swapbytes(x, bits: int = 32) -> Column:
    """Byte order reversed within an unsigned word of 16, 32 or 64 bits."""
    h = F.lpad(F.hex(col(x).cast("bigint").bitwiseAND((1 << bits) - 1 if bits < 64 else -1)), bits // 4, "0")
    pairs = F.concat(*[F.substring(h, bits // 4 - 1 - 2 * k, 2) for k in range(bits // 8)])
    return F.conv(pairs, 16, -10 if bits == 64 else 10).cast("bigint")


# Casts -------------------------------------------------------------------------------------------

_RANGES = {"int8": (-(2**7), 2**7 - 1, "smallint"), "int16": (-(2**15), 2**15 - 1, "int"), "int32": (-(2**31), 2**31 - 1, "int"), "int64": (-(2**63), 2**63 - 1, "bigint"), "uint8": (0, 2**8 - 1, "smallint"), "uint16": (0, 2**16 - 1, "int"), "uint32": (0, 2**32 - 1, "bigint"), "uint64": (0, 2**64 - 1, "decimal(20,0)")}


def integer(x, kind: str) -> Column:
    """Rounds half away from zero and saturates at the range of an integer class; NaN is 0."""
    lo, hi, carrier = _RANGES[kind]
    x = num(x)
    r = F.signum(x) * F.floor(F.abs(F.when(finite(x) & (F.abs(x) < 2.0**62), x).otherwise(0.0)) + 0.5)
    big = F.when(finite(x), x).otherwise(0.0).cast("decimal(38,0)")
    body = F.when(F.abs(x) < 2.0**62, r.cast("decimal(38,0)")).otherwise(F.when(F.abs(x) < 1e30, big).otherwise(F.lit(0).cast("decimal(38,0)")))
    low, high = F.expr(f"cast({lo} as decimal(38,0))"), F.expr(f"cast({hi} as decimal(38,0))")
    return F.when(F.isnan(x), F.lit(0).cast("decimal(38,0)")).when(x >= float(hi), high).when(x <= float(lo), low).otherwise(body).cast(carrier)


def double(x) -> Column:
    return num(x)


def single(x) -> Column:
    return col(x).cast("float")


def intmax(kind: str = "int32") -> Column:
    return F.expr(f"cast({_RANGES[kind][1]} as {_RANGES[kind][2]})")


def intmin(kind: str = "int32") -> Column:
    return F.expr(f"cast({_RANGES[kind][0]} as {_RANGES[kind][2]})")


def realmax() -> Column:
    return F.lit(1.7976931348623157e308)


def realmin() -> Column:
    return F.lit(2.2250738585072014e-308)


def flintmax() -> Column:
    return F.lit(float(2**53))


# Rounding ----------------------------------------------------------------------------------------


def _keep(x: Column, y: Column) -> Column:
    """y where x is finite and small enough to have a fraction, else x."""
    return F.when(finite(x) & (F.abs(x) < 2.0**52), y).otherwise(x)


def floor(x) -> Column:
    x = num(x)
    return _keep(x, F.floor(F.when(finite(x), x)).cast("double"))


def ceil(x) -> Column:
    x = num(x)
    return _keep(x, F.ceil(F.when(finite(x), x)).cast("double"))


def fix(x) -> Column:
    x = num(x)
    return _keep(x, F.signum(x) * F.floor(F.abs(F.when(finite(x), x))))


def round_(x, digits: int = 0) -> Column:
    """Half away from zero, at a number of decimals."""
    x = num(x)
    return F.when(finite(x), F.round(F.when(finite(x), x), digits)).otherwise(x)


def round_significant(x, digits: int) -> Column:
    x = num(x)
    ok = finite(x) & (x != 0)
    place = F.floor(F.log10(F.abs(F.when(ok, x)))) + 1 - digits
    scale = F.pow(F.lit(10.0), F.abs(place))
    up = F.signum(x) * F.floor(F.abs(F.when(place >= 0, x / scale).otherwise(x * scale)) + 0.5)
    return F.when(ok, F.when(place >= 0, up * scale).otherwise(up / scale)).otherwise(x)


# Exponents, logarithms, trigonometry -------------------------------------------------------------


def _log(f, x) -> Column:
    """A logarithm: -Inf at 0, NaN below (the real variant), NaN and Inf kept."""
    x = num(x)
    return F.when(x == 0, F.lit(-INF)).when((x < 0) | F.isnan(x), F.lit(NAN)).otherwise(f(F.when(x > 0, x)))


def log(x) -> Column:
    return _log(F.ln, x)


def log10(x) -> Column:
    return _log(F.log10, x)


def log2(x) -> Column:
    return _log(F.log2, x)


def log1p(x) -> Column:
    x = num(x)
    return F.when(x == -1, F.lit(-INF)).when((x < -1) | F.isnan(x), F.lit(NAN)).otherwise(F.log1p(F.when(x > -1, x)))


def exp(x) -> Column:
    return F.exp(num(x))


def expm1(x) -> Column:
    return F.expm1(num(x))


def sqrt(x) -> Column:
    """The real variant: NaN below zero."""
    x = num(x)
    return F.when((x < 0) | F.isnan(x), F.lit(NAN)).otherwise(F.sqrt(F.when(x >= 0, x)))


def realsqrt(x) -> Column:
    """An error below zero."""
    x = num(x)
    return F.when((x < 0) & ~F.isnan(x), F.raise_error(F.lit("realsqrt: negative input"))).otherwise(sqrt(x))


def abs_(x) -> Column:
    return F.abs(num(x))


def sign(x) -> Column:
    return F.signum(num(x))


def hypot(a, b) -> Column:
    return F.hypot(num(a), num(b))


def pow2(x, e=None) -> Column:
    return F.pow(F.lit(2.0), num(x)) if e is None else num(x) * F.pow(F.lit(2.0), num(e))


def nextpow2(x) -> Column:
    """Least p with 2^p >= |x|."""
    x = F.abs(num(x))
    p = F.ceil(F.log2(F.when(finite(x) & (x > 0), x)) - 1e-12).cast("double")
    return F.when(x == 0, F.lit(0.0)).when(finite(x), p).otherwise(x)


def heaviside(x) -> Column:
    x = num(x)
    return F.when(F.isnan(x), x).when(x < 0, 0.0).when(x == 0, 0.5).otherwise(1.0)


def _inside(f, x, lo: float, hi: float) -> Column:
    x = num(x)
    ok = (x >= lo) & (x <= hi) & ~F.isnan(x)
    return F.when(ok, f(F.when(ok, x))).otherwise(F.lit(NAN))


def acos(x) -> Column:
    return _inside(F.acos, x, -1, 1)


def asin(x) -> Column:
    return _inside(F.asin, x, -1, 1)


def acosh(x) -> Column:
    return _inside(F.acosh, x, 1, INF)


def asinh(x) -> Column:
    x = num(x)
    return F.signum(x) * F.asinh(F.abs(x))


def atan(x) -> Column:
    return F.atan(num(x))


def atan2(y, x) -> Column:
    return F.atan2(num(y), num(x))


def atanh(x) -> Column:
    x = num(x)
    ok = (F.abs(x) < 1) & ~F.isnan(x)
    return F.when(ok, F.atanh(F.when(ok, x))).when(F.abs(x) == 1, F.signum(x) * INF).otherwise(F.lit(NAN))


def _trig(f, x) -> Column:
    x = num(x)
    return F.when(finite(x), f(F.when(finite(x), x))).otherwise(F.lit(NAN))


def sin(x) -> Column:
    return _trig(F.sin, x)


def cos(x) -> Column:
    return _trig(F.cos, x)


def tan(x) -> Column:
    return _trig(F.tan, x)


def sinh(x) -> Column:
    return F.sinh(num(x))


def cosh(x) -> Column:
    return F.cosh(num(x))


def tanh(x) -> Column:
    return F.tanh(num(x))


def _quarter(x: Column, turn: float) -> tuple[Column, Column]:
    """x reduced to a full turn, and its quarter where it falls on one exactly."""
    r = mod(x, turn)
    q = F.when(mod(r, turn / 4) == 0, F.floor(F.when(finite(r), r) / (turn / 4)))
    return r, q


def sind(x) -> Column:
    """Degrees, exact at multiples of 90."""
    r, q = _quarter(num(x), 360.0)
    return F.when(q.isin(0, 2), 0.0).when(q == 1, 1.0).when(q == 3, -1.0).otherwise(F.sin(F.radians(r)))


def cosd(x) -> Column:
    r, q = _quarter(num(x), 360.0)
    return F.when(q.isin(1, 3), 0.0).when(q == 0, 1.0).when(q == 2, -1.0).otherwise(F.cos(F.radians(r)))


def tand(x) -> Column:
    r, q = _quarter(num(x), 360.0)
    return F.when(q.isin(0, 2), 0.0).when(q == 1, INF).when(q == 3, -INF).otherwise(F.tan(F.radians(r)))


def sinpi(x) -> Column:
    r, q = _quarter(num(x), 2.0)
    return F.when(q.isin(0, 2), 0.0).when(q == 1, 1.0).when(q == 3, -1.0).otherwise(F.sin(r * math.pi))


def cospi(x) -> Column:
    r, q = _quarter(num(x), 2.0)
    return F.when(q.isin(1, 3), 0.0).when(q == 0, 1.0).when(q == 2, -1.0).otherwise(F.cos(r * math.pi))


def deg2rad(x) -> Column:
    return F.radians(num(x))


def rad2deg(x) -> Column:
    return F.degrees(num(x))


def pol2cart(theta, r) -> Column:
    t, r = num(theta), num(r)
    return F.struct((r * F.cos(t)).alias("x"), (r * F.sin(t)).alias("y"))


def cart2pol(x, y) -> Column:
    return F.struct(atan2(y, x).alias("theta"), hypot(x, y).alias("r"))


def factorial(x) -> Column:
    """n! as a double: exact to 20, by the logarithm of gamma's product beyond; NaN for other numbers."""
    x = num(x)
    whole = (x >= 0) & (x == F.floor(F.when(finite(x), x)))
    small = F.factorial(F.when(whole & (x <= 20), x).cast("int")).cast("double")
    steps = F.sequence(F.lit(21), F.greatest(F.lit(21), F.least(F.lit(171), F.when(whole, x).otherwise(21.0).cast("int"))))
    large = F.aggregate(steps, F.lit(2432902008176640000.0), lambda a, k: a * k)
    return F.when(whole & (x <= 20), small).when(whole & (x > 170), F.lit(INF)).when(whole, large).otherwise(F.lit(NAN))


def gcd(a, b) -> Column:
    """Greatest common divisor of whole numbers by a bounded run of Euclid's steps."""
    start = F.struct(F.abs(col(a).cast("bigint")).alias("a"), F.abs(col(b).cast("bigint")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a, b) -> Column:
    g = gcd(a, b)
    a, b = F.abs(col(a).cast("bigint")), F.abs(col(b).cast("bigint"))
    return F.when(g == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", a, F.when(g != 0, g)) * b)


# Complex numbers as struct<re, im> ----------------------------------------------------------------


def complex_(re, im=0.0) -> Column:
    return F.struct(num(re).alias("re"), num(im).alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def conj(z: Column) -> Column:
    return F.struct(z["re"].alias("re"), (-z["im"]).alias("im"))


def angle(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def modulus(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def csqrt(x) -> Column:
    """Square root of a real number as a complex one."""
    x = num(x)
    return F.struct(F.when(x < 0, 0.0).otherwise(sqrt(x)).alias("re"), F.when(x < 0, sqrt(-x)).otherwise(0.0).alias("im"))


def clog(x) -> Column:
    x = num(x)
    return F.struct(log(F.abs(x)).alias("re"), F.when(x < 0, F.lit(math.pi)).otherwise(0.0).alias("im"))


# Colour and signal shapes ------------------------------------------------------------------------


def sinc(x) -> Column:
    x = num(x)
    return F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / F.when(x != 0, x * math.pi))


def square(t, duty: float = 50.0) -> Column:
    return F.when(mod(t, 2 * math.pi) < 2 * math.pi * duty / 100, 1.0).otherwise(-1.0)


def sawtooth(t, width: float = 1.0) -> Column:
    r = mod(t, 2 * math.pi) / (2 * math.pi)
    up = 2 * r / width - 1 if width else F.lit(-1.0)
    return F.when(r <= width, up).otherwise(1 - 2 * (r - width) / (1 - width)) if width < 1 else up


def rectpuls(t, w: float = 1.0) -> Column:
    return F.when((num(t) >= -w / 2) & (num(t) < w / 2), 1.0).otherwise(0.0)


def tripuls(t, w: float = 1.0, skew: float = 0.0) -> Column:
    t, peak = num(t), skew * w / 2
    up = (t + w / 2) / (peak + w / 2) if peak > -w / 2 else F.lit(0.0)
    down = (w / 2 - t) / (w / 2 - peak) if peak < w / 2 else F.lit(0.0)
    return F.when(F.abs(t) >= w / 2, 0.0).when(t < peak, up).otherwise(down)


def gauspuls(t, fc: float = 1000.0, bw: float = 0.5, drop_db: float = -6.0) -> Column:
    r = 10 ** (drop_db / 20)
    a = -((math.pi * fc * bw) ** 2) / (4 * math.log(r))
    t = num(t)
    return F.exp(-a * t * t) * F.cos(2 * math.pi * fc * t)


def db(x) -> Column:
    return 20 * log10(F.abs(num(x)))


def im2double(v) -> Column:
    return num(v) / 255.0


def im2uint8(v) -> Column:
    return integer(num(v) * 255.0, "uint8")


def im2uint16(v) -> Column:
    return integer(num(v) * 65535.0, "uint16")


def rgb2gray(r, g, b) -> Column:
    return 0.2989 * num(r) + 0.5870 * num(g) + 0.1140 * num(b)


def gray2rgb(v) -> Column:
    return F.array(col(v), col(v), col(v))


def rgb2hsv(r, g, b) -> Column:
    r, g, b = num(r), num(g), num(b)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    safe = F.when(d != 0, d)
    h = F.when(d == 0, 0.0).when(top == r, mod((g - b) / safe, 6.0)).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4) / 6
    return F.struct(h.alias("h"), F.when(top == 0, 0.0).otherwise(d / F.when(top != 0, top)).alias("s"), top.alias("v"))


def hsv2rgb(h, s, v) -> Column:
    h, s, v = num(h), num(s), num(v)

    def channel(n: int) -> Column:
        k = mod(n + h * 6, 6.0)
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


#: Linear sRGB to XYZ (D65) by rows, and the D65 white point.
_XYZ = [(0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)]
_WHITE = (0.95047, 1.0, 1.08883)


def rgb2lab(r, g, b) -> Column:
    lin = [F.when(num(c) <= 0.04045, num(c) / 12.92).otherwise(F.pow((num(c) + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    f = []
    for row, w in zip(_XYZ, _WHITE, strict=True):
        t = sum(k * c for k, c in zip(row, lin, strict=True)) / w
        f.append(F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29))
    return F.struct((116 * f[1] - 16).alias("L"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))


def lab2rgb(L, a, b) -> Column:  # noqa: N803
    import numpy as np

    fy = (num(L) + 16) / 116
    f = (fy + num(a) / 500, fy, fy - num(b) / 200)
    xyz = [w * F.when(t > 6 / 29, t * t * t).otherwise(3 * (6 / 29) ** 2 * (t - 4 / 29)) for t, w in zip(f, _WHITE, strict=True)]
    inv = np.linalg.inv(np.array(_XYZ))
    out = []
    for row in inv:
        lin = sum(float(k) * c for k, c in zip(row, xyz, strict=True))
        out.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(lin <= 0.0031308, 12.92 * lin).otherwise(1.055 * F.pow(F.greatest(lin, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055))))
    return F.struct(*[c.alias(n) for c, n in zip(out, ("r", "g", "b"), strict=True)])
