"""Special functions and distributions that Spark lacks, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import num


def _each(f):
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(f, x.to_numpy(dtype=float).tolist()), float, len(x)))

    return run


def _gamma(x: float) -> float:
    try:
        return math.gamma(x)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.inf if x == 0 else math.nan


def _lgamma(x: float) -> float:
    return math.nan if x < 0 else math.inf if x == 0 else math.lgamma(x)


def _erfinv(y: float) -> float:
    if not -1 < y < 1:
        return math.copysign(math.inf, y) if abs(y) == 1 else math.nan
    # A closed first guess, then Newton steps on erf.
    a = 0.147
    t = math.log1p(-y * y)
    u = 2 / (math.pi * a) + t / 2
    x = math.copysign(math.sqrt(math.sqrt(u * u - t / a) - u), y)
    for _ in range(4):
        x -= (math.erf(x) - y) / (2 / math.sqrt(math.pi) * math.exp(-x * x) or 1e-300)
    return x


def _erfcinv(y: float) -> float:
    if not 0 < y < 2:
        return math.inf if y == 0 else -math.inf if y == 2 else math.nan
    if y > 0.05:
        return _erfinv(1 - y)
    x = math.sqrt(max(-math.log(y * math.sqrt(math.pi) * math.sqrt(-math.log(y))), 0.1))
    for _ in range(12):
        x += (math.erfc(x) - y) / (2 / math.sqrt(math.pi) * math.exp(-x * x))
    return x


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def betainc(x: float, a: float, b: float) -> float:
    if math.isnan(x) or x <= 0 or x >= 1:
        return x if math.isnan(x) else float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def gammainc(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function."""
    if math.isnan(x) or x <= 0:
        return x if math.isnan(x) else 0.0
    if math.isinf(x):
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def tcdf_(t: float, nu: float) -> float:
    if math.isnan(t):
        return t
    p = betainc(nu / (nu + t * t), nu / 2, 0.5) / 2
    return 1 - p if t > 0 else p


def _betacf_of(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """`_betacf` of many numbers at once, until all stand still but for rounding, which grows with a + b."""
    tiny, c = 1e-300, np.ones(len(x))
    still = 1e-15 * np.maximum(a + b, 1)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(d == 0, tiny, d)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(d == 0, tiny, d), np.where(c == 0, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < still).all():
            break
    return h


def _tinv_half(q: np.ndarray, nu: float) -> np.ndarray:
    """t of the upper tails q, 0 < q < 0.5, by Newton steps on log probabilities over u = log t.

    log |T| has a log-concave density, so the logs of both its tails are concave in u: steps that start
    beyond the root, on the side given below, stay there and come nearer without a bracket.
    """
    a, log_nu = nu / 2, math.log(nu)
    # log gamma(a + 1/2) / (gamma(a) gamma(1/2)); where the logs of gamma cancel, by its series.
    ahead = (math.lgamma(a + 0.5) - math.lgamma(a) if a < 1000 else math.log(a) / 2 - 1 / (8 * a) + 1 / (192 * a**3)) - math.lgamma(0.5)
    tail = q <= 0.25  # the outer part is met, or the part around 0
    goal = np.log(np.where(tail, 2 * q, 1 - 2 * q))
    # pdf <= ahead * nu ** a * t ** (-nu - 1), and pdf <= pdf(0).
    u = np.where(tail, log_nu / 2 + (ahead - log_nu - np.log(q)) / nu, goal - math.log(2) - ahead + log_nu / 2)
    for _ in range(500):
        log_x, log_y = -np.logaddexp(0, 2 * u - log_nu), -np.logaddexp(0, log_nu - 2 * u)  # of nu / (nu + t^2) and the rest to 1
        x, y = np.exp(log_x), np.exp(log_y)
        outer = y > 1.5 / (a + 2.5)  # the fraction that converges fast gives this part, the other is the rest to 1
        front = ahead + a * log_x + 0.5 * log_y
        part = front + np.log(_betacf_of(np.where(outer, a, 0.5), np.where(outer, 0.5, a), np.where(outer, x, y)) / np.where(outer, a, 0.5))
        now = np.where(outer == tail, part, np.log(-np.expm1(np.minimum(part, -1e-300))))
        step = (now - goal) / (2 * np.exp(front - now)) * np.where(tail, -1, 1)
        u = u - step
        if (np.abs(step) < 1e-9).all():  # steps are quadratic: the next one is below the precision
            break
    return np.exp(u)


def _tinv(p: np.ndarray, nu: float) -> np.ndarray:
    out = np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan))
    if not nu > 0:
        return np.full(len(p), np.nan)
    inside = (p > 0) & (p < 1)
    v, back = np.unique(p[inside], return_inverse=True)
    q = np.minimum(v, 1 - v)
    t = np.zeros(len(v))
    some = q < 0.5
    if math.isinf(nu):
        t[some] = [math.sqrt(2) * _erfcinv(2 * x) for x in q[some].tolist()]
    elif some.any():
        with np.errstate(over="ignore", under="ignore"):
            t[some] = _tinv_half(q[some], nu)
    out[inside] = np.where(v < 0.5, -t, t)[back]
    return out


def tinv_(p: float, nu: float) -> float:
    return float(_tinv(np.array([p], dtype=float), nu)[0])


def erf(x) -> Column:
    return _each(math.erf)(num(x))


def erfc(x) -> Column:
    return _each(math.erfc)(num(x))


def erfinv(x) -> Column:
    return _each(_erfinv)(num(x))


def erfcinv(x) -> Column:
    return _each(_erfcinv)(num(x))


def gamma(x) -> Column:
    return _each(_gamma)(num(x))


def gammaln(x) -> Column:
    return _each(_lgamma)(num(x))


def normcdf(x, mu: float = 0.0, sigma: float = 1.0) -> Column:
    return 0.5 * erfc((mu - num(x)) / (sigma * math.sqrt(2)))


def norminv(p, mu: float = 0.0, sigma: float = 1.0) -> Column:
    return mu - sigma * math.sqrt(2) * erfcinv(2 * num(p))


def normpdf(x, mu: float = 0.0, sigma: float = 1.0) -> Column:
    z = (num(x) - mu) / sigma
    return F.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi))


def tcdf(x, nu: float) -> Column:
    return _each(lambda v: tcdf_(v, nu))(num(x))


def tpdf(x, nu: float) -> Column:
    x = num(x)
    front = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    return front * F.pow(1 + x * x / nu, F.lit(-(nu + 1) / 2))


def tinv(p, nu: float) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(_tinv(x.to_numpy(dtype=float), nu))

    return run(num(p))


def chi2cdf(x, k: float) -> Column:
    return _each(lambda v: gammainc(v / 2, k / 2))(num(x))


def binocdf(x, n: int, p: float) -> Column:
    return _each(lambda v: 0.0 if v < 0 else 1.0 if v >= n else 1 - betainc(p, math.floor(v) + 1, n - math.floor(v)))(num(x))


def wblinv(p, a: float, b: float) -> Column:
    return a * F.pow(-F.log1p(-num(p)), F.lit(1 / b))


def blsprice(price, strike, rate, time, sigma) -> Column:
    """Call and put prices of European options in closed form."""
    s, k, r, t, v = map(num, (price, strike, rate, time, sigma))
    sd = v * F.sqrt(t)
    d1 = (F.ln(s / k) + (r + v * v / 2) * t) / sd
    d2, disc = d1 - sd, k * F.exp(-r * t)
    call = s * normcdf(d1) - disc * normcdf(d2)
    return F.struct(call.alias("call"), (call - s + disc).alias("put"))
