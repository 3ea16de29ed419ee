"""Arrays held in one row (ArrayType): creation, shape, vector algebra, windows, polynomials."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import NAN, col, num


def colon(a, step, b) -> Column:
    """a : step : b as doubles, ends included where they are met."""
    a, step, b = num(a), num(step), num(b)
    n = F.floor((b - a) / step + 1e-10).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: a + i * step)).otherwise(F.array().cast("array<double>"))


def linspace(a, b, n: int = 100) -> Column:
    a, b = num(a), num(b)
    if n < 2:
        return F.array(b)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, b).otherwise(a + i * (b - a) / (n - 1)))


def logspace(a, b, n: int = 50) -> Column:
    return F.transform(linspace(a, b, n), lambda x: F.pow(F.lit(10.0), x))


def fill(v, n: int) -> Column:
    return F.array_repeat(col(v), n)


def zeros(n: int) -> Column:
    return fill(0.0, n)


def ones(n: int) -> Column:
    return fill(1.0, n)


def true_(n: int) -> Column:
    return fill(True, n)


def false_(n: int) -> Column:
    return fill(False, n)


def nan_(n: int) -> Column:
    return fill(NAN, n)


def inf_(n: int) -> Column:
    return fill(math.inf, n)


def empty(kind: str = "double") -> Column:
    return F.array().cast(f"array<{kind}>")


def flip(a) -> Column:
    return F.reverse(col(a))


def circshift(a, k: int) -> Column:
    a = col(a)
    n = F.size(a)
    s = F.pmod(F.lit(k), F.greatest(n, F.lit(1))).cast("int")
    return F.when(n == 0, a).otherwise(F.concat(F.slice(a, n - s + 1, s), F.slice(a, F.lit(1), n - s)))


def repmat(a, n: int) -> Column:
    return F.flatten(F.array_repeat(col(a), n))


def repelem(a, n: int) -> Column:
    return F.flatten(F.transform(col(a), lambda x: F.array_repeat(x, n)))


def horzcat(*arrays) -> Column:
    return F.concat(*[col(a) for a in arrays])


def reshape(a, rows: int) -> Column:
    """Column-major: an array of columns, each of `rows` values."""
    a = col(a)
    cols = F.call_function("div", F.size(a), F.lit(rows)).cast("int")
    return F.transform(F.sequence(F.lit(0), cols - 1), lambda j: F.slice(a, j * rows + 1, F.lit(rows)))


def numel(a) -> Column:
    return F.size(col(a))


def isempty(a) -> Column:
    return F.size(col(a)) == 0


def isscalar(a) -> Column:
    return F.size(col(a)) == 1


def isrow(a) -> Column:
    """An array is a row; a null is not."""
    return col(a).isNotNull()


def iscolumn(a) -> Column:
    return F.size(col(a)) == 1


def isvector(a) -> Column:
    return F.size(col(a)) >= 1


def ismatrix(a) -> Column:
    return col(a).isNotNull()


def ndims(a) -> Column:
    return F.when(col(a).isNotNull(), F.lit(2))


def permute(a, order) -> Column:
    """A nested array with its dimensions in another order: [1, 2] or [2, 1]."""
    if sorted(order) != [1, 2]:
        raise ValueError("order must be a permutation of [1, 2]")
    m = col(a)
    if list(order) == [1, 2]:
        return m
    across = F.sequence(F.lit(0), F.greatest(F.size(F.get(m, F.lit(0))) - 1, F.lit(0)))
    return F.when(F.size(m) > 0, F.transform(across, lambda j: F.transform(m, lambda row: F.get(row, j)))).otherwise(m)


def ipermute(a, order) -> Column:
    """Undoes `permute`."""
    return permute(a, [list(order).index(k) + 1 for k in (1, 2)])


def squeeze(a) -> Column:
    """The only page of an array of pages."""
    m = col(a)
    return F.when(F.size(m) == 1, F.get(m, F.lit(0)))


def find(a) -> Column:
    """1-based places of nonzero values."""
    return F.filter(F.transform(col(a), lambda x, i: F.when(x != 0, i + 1)), lambda x: x.isNotNull())


def ind2sub(k, rows: int) -> Column:
    k = col(k).cast("bigint")
    return F.struct(((k - 1) % rows + 1).alias("row"), (F.call_function("div", k - 1, F.lit(rows)) + 1).alias("column"))


def sub2ind(i, j, rows: int) -> Column:
    return (col(j).cast("bigint") - 1) * rows + col(i).cast("bigint")


def padsequences(a, n: int, v: float = 0.0, side: str = "right") -> Column:
    a = col(a)
    gap = F.array_repeat(F.lit(v), F.greatest(F.lit(n) - F.size(a), F.lit(0)))
    return F.concat(a, gap) if side == "right" else F.concat(gap, a)


def num2cell(a) -> Column:
    return F.transform(col(a), lambda x: F.array(x))


def cell2mat(a) -> Column:
    return F.flatten(col(a))


def mat2cell(a, sizes: list[int]) -> Column:
    at, parts = 1, []
    for n in sizes:
        parts.append(F.slice(col(a), at, n))
        at += n
    return F.array(*parts)


# Vector algebra ----------------------------------------------------------------------------------


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a, p: float = 2) -> Column:
    v = F.transform(col(a), lambda x: F.abs(x.cast("double")))
    if p == math.inf:
        return F.array_max(v)
    if p == -math.inf:
        return F.array_min(v)
    if p == 2:
        return F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return F.pow(_sum(F.transform(v, lambda x: F.pow(x, F.lit(float(p))))), F.lit(1.0 / p))


def cross(a, b) -> Column:
    g = lambda v, i: F.get(col(v), F.lit(i)).cast("double")
    return F.array(*[g(a, j) * g(b, k) - g(a, k) * g(b, j) for j, k in ((1, 2), (2, 0), (0, 1))])


def cosine(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n)).otherwise(F.lit(NAN))


def distance(a, b, metric: str = "euclidean") -> Column:
    d = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))
    if metric == "euclidean":
        return norm(d)
    if metric == "squaredeuclidean":
        return _sum(F.transform(d, lambda x: x * x))
    if metric == "cityblock":
        return norm(d, 1)
    if metric == "chebychev":
        return norm(d, math.inf)
    if metric == "cosine":
        return 1 - cosine(a, b)
    raise ValueError(f"unknown metric {metric}")


def conv(a, b) -> Column:
    """Full convolution of two short arrays."""
    a, b = col(a), col(b)
    n, m = F.size(a), F.size(b)
    at = F.sequence(F.lit(0), n + m - 2)
    return F.transform(at, lambda k: _sum(F.transform(F.sequence(F.greatest(F.lit(0), k - m + 1), F.least(k, n - 1)), lambda i: F.get(a, i).cast("double") * F.get(b, k - i).cast("double"))))


def polyval(p, x) -> Column:
    """Horner's rule; the highest power first."""
    x = num(x)
    return F.aggregate(col(p), F.lit(0.0), lambda s, c: s * x + c.cast("double"))


def polyder(p) -> Column:
    p = col(p)
    n = F.size(p)
    d = F.slice(F.transform(p, lambda c, i: c.cast("double") * (n - 1 - i)), F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.when(n > 1, d).otherwise(F.array(F.lit(0.0)))


def polyint(p, k: float = 0.0) -> Column:
    p = col(p)
    n = F.size(p)
    return F.concat(F.transform(p, lambda c, i: c.cast("double") / (n - i)), F.array(F.lit(k)))


def cumsum(a) -> Column:
    """Running sums of a short array (work grows with the square of its length; use windows for long ones)."""
    a = F.transform(col(a), lambda x: x.cast("double"))
    return F.transform(a, lambda _, i: _sum(F.slice(a, F.lit(1), i + 1)))


# Windows -----------------------------------------------------------------------------------------


def _cosines(n: int, terms: list[float]) -> Column:
    if n == 1:
        return F.array(F.lit(1.0))
    at = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(at, lambda i: sum(c * F.cos(2 * math.pi * k * i / (n - 1)) for k, c in enumerate(terms)))


def hamming(n: int) -> Column:
    return _cosines(n, [0.54, -0.46])


def hann(n: int) -> Column:
    return _cosines(n, [0.5, -0.5])


def blackman(n: int) -> Column:
    return _cosines(n, [0.42, -0.5, 0.08])


def fftshift(a) -> Column:
    a = col(a)
    h = F.ceil(F.size(a) / 2).cast("int")
    return F.concat(F.slice(a, h + 1, F.size(a) - h), F.slice(a, F.lit(1), h))


def ifftshift(a) -> Column:
    a = col(a)
    h = F.floor(F.size(a) / 2).cast("int")
    return F.concat(F.slice(a, h + 1, F.size(a) - h), F.slice(a, F.lit(1), h))


def de2bi(x, n: int) -> Column:
    """Bits of a whole number, lowest first."""
    x = col(x).cast("bigint")
    return F.array(*[F.shiftright(x, k).bitwiseAND(1).cast("int") for k in range(n)])


def bi2de(bits) -> Column:
    return F.aggregate(F.reverse(col(bits)), F.lit(0).cast("bigint"), lambda s, b: s * 2 + b.cast("bigint"))


def pskmod(k, m: int, phase: float = 0.0) -> Column:
    a = num(k) * (2 * math.pi / m) + phase
    return F.struct(F.cos(a).alias("re"), F.sin(a).alias("im"))


def qammod(k, m: int) -> Column:
    """Square constellation with Gray-coded columns and rows."""
    side = math.isqrt(m)
    if side * side != m:
        raise ValueError("m must be a square")
    k = col(k).cast("bigint")
    bits = side.bit_length() - 1

    def level(g: Column) -> Column:
        b = g
        for s in range(1, bits):
            b = b.bitwiseXOR(F.shiftright(g, s))
        return (2 * b - side + 1).cast("double")

    return F.struct(level(F.shiftright(k, bits)).alias("re"), (-level(k.bitwiseAND(side - 1))).alias("im"))
