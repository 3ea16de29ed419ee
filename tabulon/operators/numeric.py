"""Small numeric algorithms on the driver, and their distributed use: one call for each series or row group.

Matrices, polynomials and curves here are small by nature; tables meet them through `per_group`, which
runs a numpy function on each group, or through the Column forms of `ppval` and `transfer`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions.elementwise import NAN, num


def per_group(df: DataFrame, groups: Sequence[str], order: Sequence[str], columns: Sequence[str], f: Callable[..., dict], out: str) -> DataFrame:
    """f(arrays...) -> named arrays for each group; a group must fit in a task."""
    keys = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in groups)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(list(order), kind="stable")
        r = f(*[p[c].to_numpy(float) for c in columns])
        n = len(next(iter(r.values())))
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] * n for g in groups}, **r})

    return df.select(*dict.fromkeys([*groups, *order, *columns])).groupBy(*groups).applyInPandas(run, f"{keys}, {out}")


# Combinatorics and number tables -------------------------------------------------------------------


def primes(spark: SparkSession, n: int) -> DataFrame:
    """Primes up to n: multiples of the primes up to sqrt(n) are taken away by an anti-join."""
    if n < 2:
        return spark.createDataFrame([], "p long")
    root = math.isqrt(n)
    small = [p for p in range(2, root + 1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    all_ = spark.range(2, n + 1).select(F.col("id").alias("p"))
    if not small:
        return all_
    sieve = spark.createDataFrame([(p,) for p in small], "q long").select(F.explode(F.sequence(F.col("q") * F.col("q"), F.greatest(F.lit(n), F.col("q") * F.col("q")), F.col("q"))).alias("p"))
    return all_.join(sieve.filter(F.col("p") <= n).dropDuplicates(), "p", "left_anti")


def nchoosek(n: int | Sequence, k: int):
    """The binomial coefficient, or all k-combinations of a vector."""
    return math.comb(n, k) if isinstance(n, int) else list(itertools.combinations(n, k))


def perms(v: Sequence) -> list[tuple]:
    return sorted(itertools.permutations(v), reverse=True)


def magic(n: int) -> np.ndarray:
    """A magic square of order n >= 3."""
    if n < 3:
        raise ValueError("order must be at least 3")
    if n % 2:
        i, j = np.mgrid[1 : n + 1, 1 : n + 1]
        return n * ((i + j - 1 + n // 2) % n) + (i + 2 * j - 2) % n + 1
    if n % 4 == 0:
        m = np.arange(1, n * n + 1).reshape(n, n)
        i, j = np.mgrid[0:n, 0:n]
        flip = (i % 4 == j % 4) | ((i % 4) + (j % 4) == 3)
        return np.where(flip, n * n + 1 - m, m)
    h = n // 2
    q = magic(h)
    m = np.block([[q, q + 2 * h * h], [q + 3 * h * h, q + h * h]])
    k = (n - 2) // 4
    swap = [*range(k), *range(n - k + 1, n)]
    m[np.ix_([*range(h), *range(h, n)], swap)] = m[np.ix_([*range(h, n), *range(h)], swap)]
    m[[k, k + h], 0] = m[[k + h, k], 0]
    m[[k, k + h], k] = m[[k + h, k], k]
    return m


def peaks(spark: SparkSession, n: int = 49) -> DataFrame:
    """A sample surface on a grid over [-3, 3]."""
    step = 6.0 / (n - 1)
    g = spark.range(n).select((F.col("id") + 1).alias("i"), (F.col("id") * step - 3).alias("y")).crossJoin(spark.range(n).select((F.col("id") + 1).alias("j"), (F.col("id") * step - 3).alias("x")))
    x, y = F.col("x"), F.col("y")
    z = 3 * (1 - x) * (1 - x) * F.exp(-x * x - (y + 1) * (y + 1)) - 10 * (x / 5 - x * x * x - F.pow(y, F.lit(5.0))) * F.exp(-x * x - y * y) - F.exp(-(x + 1) * (x + 1) - y * y) / 3
    return g.withColumn("z", z)


def randperm(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """A permutation of 1..n by the order of hashes."""
    from tabulon.operators.table import number_rows

    d = spark.range(1, n + 1).withColumn("h", F.xxhash64(F.lit(seed), "id"))
    return number_rows(d, ["h", "id"], "place").select("place", F.col("id").alias("value"))


def lhsdesign(n: int, p: int, seed: int = 1) -> np.ndarray:
    """Latin hypercube sample: one value in each of n strata of every column."""
    rng = np.random.default_rng(seed)
    return np.column_stack([(rng.permutation(n) + rng.random(n)) / n for _ in range(p)])


def mvnrnd(df: DataFrame, mu: Sequence[float], sigma: Sequence[Sequence[float]], seed: int = 1) -> DataFrame:
    """Adds columns x1..xk of a multivariate normal: a small Cholesky factor times independent normals."""
    low = np.linalg.cholesky(np.asarray(sigma, float))
    z = df.withColumns({f"__z{k}": F.randn(seed + k) for k in range(len(mu))})
    x = {f"x{i + 1}": F.lit(float(mu[i])) + sum(float(low[i, k]) * F.col(f"__z{k}") for k in range(i + 1)) for i in range(len(mu))}
    return z.withColumns(x).drop(*[f"__z{k}" for k in range(len(mu))])


# Roots, minima, integrals, equations ---------------------------------------------------------------


def fzero(f: Callable[[float], float], a: float, b: float, tol: float = 1e-13) -> float:
    """Bisection with secant steps inside a bracket."""
    fa, fb = f(a), f(b)
    if fa * fb > 0:
        raise ValueError("the ends must differ in sign")
    for _ in range(200):
        x = b - fb * (b - a) / (fb - fa) if fb != fa else (a + b) / 2
        if not min(a, b) < x < max(a, b) or _ % 3 == 2:
            x = (a + b) / 2
        fx = f(x)
        if fx == 0 or abs(b - a) < tol * max(1.0, abs(x)):
            return x
        if fa * fx < 0:
            b, fb = x, fx
        else:
            a, fa = x, fx
    return (a + b) / 2


def fminbnd(f: Callable[[float], float], a: float, b: float, tol: float = 1e-10) -> float:
    """Golden-section search."""
    r = (math.sqrt(5) - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = f(d)
    return (a + b) / 2


def integral(f: Callable[[float], float], a: float, b: float, tol: float = 1e-10) -> float:
    """Adaptive Simpson."""

    def simpson(fa: float, fm: float, fb: float, h: float) -> float:
        return h / 6 * (fa + 4 * fm + fb)

    def go(a: float, b: float, fa: float, fm: float, fb: float, whole: float, tol: float, depth: int) -> float:
        m = (a + b) / 2
        l, r = f((a + m) / 2), f((m + b) / 2)  # noqa: E741
        left, right = simpson(fa, l, fm, m - a), simpson(fm, r, fb, b - m)
        if depth <= 0 or abs(left + right - whole) <= 15 * tol:
            return left + right + (left + right - whole) / 15
        return go(a, m, fa, l, fm, left, tol / 2, depth - 1) + go(m, b, fm, r, fb, right, tol / 2, depth - 1)

    fa, fm, fb = f(a), f((a + b) / 2), f(b)
    return go(a, b, fa, fm, fb, simpson(fa, fm, fb, b - a), tol, 50)


quad = integral


def fsolve(f: Callable[[np.ndarray], np.ndarray], x0: Sequence[float], rounds: int = 100) -> np.ndarray:
    """Damped Newton with a difference Jacobian."""
    x = np.asarray(x0, float)
    for _ in range(rounds):
        r = np.asarray(f(x), float)
        if np.abs(r).max() < 1e-12:
            break
        jac = np.column_stack([(np.asarray(f(x + h), float) - r) / h[k] for k, h in enumerate(np.diag(1e-7 * np.maximum(1, np.abs(x))))])
        step = np.linalg.lstsq(jac, r, rcond=None)[0]
        t = 1.0
        while t > 1e-6 and np.linalg.norm(f(x - t * step)) > np.linalg.norm(r):
            t /= 2
        x = x - t * step
    return x


def lsqcurvefit(f: Callable, p0: Sequence[float], x: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Levenberg-Marquardt."""
    p, lam = np.asarray(p0, float), 1e-3
    r = f(p, x) - y
    for _ in range(rounds):
        jac = np.column_stack([(f(p + h, x) - y - r) / h[k] for k, h in enumerate(np.diag(1e-7 * np.maximum(1, np.abs(p))))])
        g = jac.T @ jac
        step = np.linalg.solve(g + lam * np.diag(np.diag(g) + 1e-12), jac.T @ r)
        new = f(p - step, x) - y
        if new @ new < r @ r:
            p, r, lam = p - step, new, lam / 3
            if np.linalg.norm(step) < 1e-12 * (1 + np.linalg.norm(p)):
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    return p


#: Dormand-Prince nodes, stages and weights of orders 5 and 4.
_DP = [[], [1 / 5], [3 / 40, 9 / 40], [44 / 45, -56 / 15, 32 / 9], [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729], [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656], [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84]]
_DP_C = [0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1]
_DP_E = [71 / 57600, 0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40]


def ode45(f: Callable, span: tuple[float, float], y0: Sequence[float], rtol: float = 1e-6, atol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive Runge-Kutta of order 5 with an embedded error."""
    t, y, h = span[0], np.asarray(y0, float), (span[1] - span[0]) / 100
    ts, ys = [t], [y]
    while t < span[1]:
        h = min(h, span[1] - t)
        k: list[np.ndarray] = []
        for a, c in zip(_DP, _DP_C, strict=True):
            k.append(np.asarray(f(t + c * h, y + h * sum((x * z for x, z in zip(a, k, strict=False)), np.zeros_like(y))), float))
        new = y + h * sum(x * z for x, z in zip(_DP[6], k, strict=False))
        err = np.abs(h * sum(e * z for e, z in zip(_DP_E, k, strict=True))) / (atol + rtol * np.maximum(np.abs(y), np.abs(new)))
        e = float(err.max(initial=0))
        if e <= 1:
            t, y = t + h, new
            ts.append(t)
            ys.append(y)
        h *= min(5.0, max(0.2, 0.9 * (e or 1e-10) ** -0.2))
    return np.array(ts), np.array(ys)


ode23 = ode45


# Curves ------------------------------------------------------------------------------------------


def spline(x: Sequence[float], y: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Breaks and cubic coefficients (highest first) with not-a-knot ends; fewer than 4 points give the polynomial."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n < 4:
        p = np.polyfit(x, y, n - 1)
        local = [np.poly1d(p)(np.poly1d([1, a])).coeffs if n > 1 else p for a in x[:-1]]
        return x, np.array([np.pad(np.atleast_1d(c), (4 - len(np.atleast_1d(c)), 0)) for c in local])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        r[i] = 3 * (h[i] * d[i - 1] + h[i - 1] * d[i])
    a[0, :2], r[0] = (h[1], h[0] + h[1]), ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    a[-1, -2:], r[-1] = (h[-1] + h[-2], h[-2]), (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    return x, _hermite(h, d, y, np.linalg.solve(a, r))


def pchip(x: Sequence[float], y: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Shape-preserving cubic: weighted harmonic slopes inside, limited one-sided ones at the ends."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    s = np.zeros(len(x))
    for k in range(1, len(x) - 1):
        if d[k - 1] * d[k] > 0:
            w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            s[k] = (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if v * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(v) > 3 * abs(d0) else v

    if len(x) > 2:
        s[0], s[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    else:
        s[:] = d[0]
    return x, _hermite(h, d, y, s)


def _hermite(h: np.ndarray, d: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.column_stack([(s[:-1] + s[1:] - 2 * d) / h**2, (3 * d - 2 * s[:-1] - s[1:]) / h, s[:-1], y[:-1]])


def ppval(breaks: Sequence[float], coefs: np.ndarray, x) -> Column:
    """A piecewise polynomial as a Column: the piece is found in a constant array, then Horner's rule."""
    v = num(x)
    edges = F.array(*[F.lit(float(b)) for b in breaks[1:-1]]) if len(breaks) > 2 else F.array().cast("array<double>")
    k = F.size(F.filter(edges, lambda e: e <= v))
    table = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in coefs])
    left = F.get(F.array(*[F.lit(float(b)) for b in breaks[:-1]]), k)
    return F.when(F.isnan(v), F.lit(NAN)).otherwise(F.aggregate(F.get(table, k), F.lit(0.0), lambda s, c: s * (v - left) + c))


def interp2(grid: DataFrame, queries: DataFrame, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """Bilinear values on a unit grid (x, y, v): four equi-joins on whole corners; NaN outside."""
    q = queries.withColumn("__i", F.floor(x)).withColumn("__j", F.floor(y))
    out = q
    for a, b in ((0, 0), (1, 0), (0, 1), (1, 1)):
        g = grid.select((F.col(x).cast("long") - a).alias("__i"), (F.col(y).cast("long") - b).alias("__j"), num(v).alias(f"__v{a}{b}"))
        out = out.join(g, ["__i", "__j"], "left")
    s, t = F.col(x) - F.col("__i"), F.col(y) - F.col("__j")
    part = lambda a, b, w: F.when(w == 0, 0.0).otherwise(w * F.col(f"__v{a}{b}"))
    z = part(0, 0, (1 - s) * (1 - t)) + part(1, 0, s * (1 - t)) + part(0, 1, (1 - s) * t) + part(1, 1, s * t)
    return out.withColumn(v, F.coalesce(z, F.lit(NAN))).select(*queries.columns, v)


# Transfer functions -----------------------------------------------------------------------------


class TransferFunction:
    """A ratio of polynomials, highest power first; ts > 0 marks a sampled system."""

    def __init__(self, num_: Sequence[float], den: Sequence[float] = (1.0,), ts: float = 0.0):
        self.num, self.den, self.ts = np.trim_zeros(np.atleast_1d(np.asarray(num_, float)), "f"), np.asarray(den, float), ts
        if not len(self.num):
            self.num = np.zeros(1)

    def _of(self, o) -> TransferFunction:
        return o if isinstance(o, TransferFunction) else TransferFunction([o], [1.0], self.ts)

    def __add__(self, o):
        o = self._of(o)
        return TransferFunction(np.polyadd(np.polymul(self.num, o.den), np.polymul(o.num, self.den)), np.polymul(self.den, o.den), self.ts)

    def __neg__(self):
        return TransferFunction(-self.num, self.den, self.ts)

    def __pos__(self):
        return self

    def __sub__(self, o):
        return self + -self._of(o)

    def __mul__(self, o):
        o = self._of(o)
        return TransferFunction(np.polymul(self.num, o.num), np.polymul(self.den, o.den), self.ts)

    __matmul__ = __mul__

    def __truediv__(self, o):
        o = self._of(o)
        return TransferFunction(np.polymul(self.num, o.den), np.polymul(self.den, o.num), self.ts)

    def __pow__(self, k: int):
        out = TransferFunction([1.0], [1.0], self.ts)
        for _ in range(abs(k)):
            out = out * self
        return out if k >= 0 else TransferFunction(out.den, out.num, self.ts)

    def feedback(self, other=1.0, sign: int = -1) -> TransferFunction:
        o = self._of(other)
        return TransferFunction(np.polymul(self.num, o.den), np.polysub(np.polymul(self.den, o.den), sign * np.polymul(self.num, o.num)), self.ts)

    def pole(self) -> np.ndarray:
        return np.roots(self.den)

    def zero(self) -> np.ndarray:
        return np.roots(self.num)

    def dcgain(self) -> float:
        z = 1.0 if self.ts else 0.0
        d = np.polyval(self.den, z)
        return float(np.polyval(self.num, z) / d) if d else math.inf

    def isstable(self) -> bool:
        p = self.pole()
        return bool((np.abs(p) < 1).all() if self.ts else (p.real < 0).all())

    def damp(self) -> tuple[np.ndarray, np.ndarray]:
        """Natural frequencies and damping ratios."""
        p = np.log(self.pole().astype(complex)) / self.ts if self.ts else self.pole()
        w = np.abs(p)
        return w, -np.real(p) / np.where(w == 0, 1, w)

    def response(self, w: Sequence[float]) -> np.ndarray:
        s = np.exp(1j * np.asarray(w) * self.ts) if self.ts else 1j * np.asarray(w)
        return np.polyval(self.num, s) / np.polyval(self.den, s)

    nyquist = response

    def ss(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Controllable canonical form."""
        n = len(self.den) - 1
        a, den = np.zeros((n, n)), self.den / self.den[0]
        b = np.pad(self.num / self.den[0], (n + 1 - len(self.num), 0))
        if n:
            a[0], a[1:, :-1] = -den[1:], np.eye(n - 1)
        return a, np.eye(n, 1), (b[1:] - b[0] * den[1:])[None, :], np.array([[b[0]]])

    def step(self, t: Sequence[float]) -> np.ndarray:
        """Step response on an even time grid, by the exact map of one step."""
        a, b, c, d = self.ss()
        if self.ts:
            ad, bd = a, b
        else:
            n = len(a)
            m = _expm(np.block([[a, b], [np.zeros((1, n + 1))]]) * (t[1] - t[0]))
            ad, bd = m[:n, :n], m[:n, n:]
        x, out = np.zeros((len(a), 1)), []
        for _ in t:
            out.append(float((c @ x + d)[0, 0]))
            x = ad @ x + bd
        return np.array(out)

    def impulse(self, t: Sequence[float]) -> np.ndarray:
        """Impulse response: the step response of s times the system."""
        if self.ts:
            y = self.step(t)
            return np.diff(y, prepend=0.0) / self.ts
        a, b, c, _ = self.ss()
        e, x, out = _expm(a * (t[1] - t[0])), b.copy(), []
        for _ in t:
            out.append(float((c @ x)[0, 0]))
            x = e @ x
        return np.array(out)


def _expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling and squaring of a Taylor sum."""
    k = max(0, int(np.ceil(np.log2(max(np.linalg.norm(a, 1), 1e-300)))) + 4)
    x, term, out = a / 2**k, np.eye(len(a)), np.eye(len(a))
    for n in range(1, 19):
        term = term @ x / n
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def stepinfo(t: Sequence[float], y: Sequence[float], final: float | None = None) -> dict[str, float]:
    """Rise time (10 to 90 %), settling time (2 %), overshoot in percent and peak."""
    t, y = np.asarray(t, float), np.asarray(y, float)
    f = y[-1] if final is None else final
    cross = lambda level: float(t[np.argmax(y * np.sign(f) >= level * abs(f))])
    off = np.flatnonzero(np.abs(y - f) > 0.02 * abs(f))
    return {"rise": cross(0.9) - cross(0.1), "settling": float(t[min(off[-1] + 1, len(t) - 1)]) if len(off) else float(t[0]), "overshoot": max(0.0, float((y / f).max() - 1) * 100), "peak": float(np.abs(y).max())}


def lqr(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Gain of the continuous quadratic regulator from the stable subspace of the Hamiltonian matrix."""
    ri = np.linalg.inv(r)
    w, v = np.linalg.eig(np.block([[a, -b @ ri @ b.T], [-q, -a.T]]))
    s = v[:, w.real < 0]
    n = len(a)
    return ri @ b.T @ np.real(s[n:] @ np.linalg.inv(s[:n]))


# Clustering and classes ---------------------------------------------------------------------------


def linkage(x: np.ndarray, method: str = "single") -> np.ndarray:
    """Merge rows (a, b, distance) of a small point set, clusters numbered from 1 as in the usual tree."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups, out = {i + 1: [i] for i in range(len(x))}, []
    pick = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(groups) > 1:
        best = min(((float(pick(d[np.ix_(p, q)])), a, b) for a, p in groups.items() for b, q in groups.items() if a < b))
        out.append((best[1], best[2], best[0]))
        groups[len(x) + len(out)] = groups.pop(best[1]) + groups.pop(best[2])
    return np.array(out)


def mnrfit(df: DataFrame, features: Sequence[str], label: str):
    """Multinomial logistic regression without penalty; `model.transform` predicts."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=list(features), outputCol="__features").transform(df)
    return LogisticRegression(featuresCol="__features", labelCol=label, family="multinomial", regParam=0.0, maxIter=200, tol=1e-9).fit(v)


def delaunay_boundary(triangles: DataFrame) -> DataFrame:
    """Edges used by exactly one triangle (a, b, c)."""
    e = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))])
    return triangles.select(F.inline(e)).groupBy("a", "b").count().filter("count = 1").select("a", "b")


def point_location(triangles: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """The least triangle (t, x1..y3) that holds each point (p, x, y): a join on grid cells, then barycentric tests."""
    xs, ys = [F.col(f"x{k}") for k in (1, 2, 3)], [F.col(f"y{k}") for k in (1, 2, 3)]
    span = lambda v: F.sequence(F.floor(F.least(*v) / cell), F.floor(F.greatest(*v) / cell))
    t = triangles.withColumn("__i", F.explode(span(xs))).withColumn("__j", F.explode(span(ys)))
    p = points.withColumn("__i", F.floor(F.col("x") / cell)).withColumn("__j", F.floor(F.col("y") / cell))
    side = lambda a, b: (xs[b] - xs[a]) * (F.col("y") - ys[a]) - (ys[b] - ys[a]) * (F.col("x") - xs[a])
    s = [side(0, 1), side(1, 2), side(2, 0)]
    inside = ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))
    hit = p.join(t, ["__i", "__j"]).filter(inside).groupBy("p").agg(F.min("t").alias("t"))
    return points.select("p").join(hit, "p", "left")


def row_count_window(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "k") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
