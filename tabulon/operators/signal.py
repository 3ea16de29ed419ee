"""Series operators: convolution and FIR filters as joins or lags, FFT and IIR per group with numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.elementwise import num


def fir(df: DataFrame, column: str, taps: Sequence[float], order: Sequence[str], groups: Sequence[str], name: str = "filtered") -> DataFrame:
    """Causal filter: a weighted sum of lags, zero before the start."""
    w = Window.partitionBy(*groups).orderBy(*order)
    y = sum(F.lit(float(t)) * F.coalesce(F.lag(num(column), k).over(w), F.lit(0.0)) for k, t in enumerate(taps))
    return df.withColumn(name, y)


def conv(a: DataFrame, b: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Full convolution of series (k, v) from 0, by a join on all index pairs of a group and a sum by k1 + k2."""
    x = a.select(*groups, F.col("k").alias("p"), F.col("v").alias("x"))
    y = b.select(*groups, F.col("k").alias("q"), F.col("v").alias("y"))
    both = x.join(y, list(groups)) if groups else x.crossJoin(y)
    return both.groupBy(*groups, (F.col("p") + F.col("q")).alias("k")).agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def conv2(m: DataFrame, kernel: Sequence[Sequence[float]], shape: str = "full", rows: int | None = None, cols: int | None = None) -> DataFrame:
    """2-D convolution of (i, j, v) with a small kernel; each cell sends its products to the cells it reaches."""
    k = np.asarray(kernel, float)
    cells = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(float(k[p, q])).alias("w")) for p in range(k.shape[0]) for q in range(k.shape[1]) if k[p, q]])
    out = m.select("i", "j", "v", F.inline(cells)).groupBy((F.col("i") + F.col("p")).alias("i"), (F.col("j") + F.col("q")).alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    if shape == "same":
        di, dj = k.shape[0] // 2, k.shape[1] // 2
        out = out.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), "v").filter(F.col("i").between(1, rows) & F.col("j").between(1, cols))
    return out


def filter2(m: DataFrame, kernel: Sequence[Sequence[float]], rows: int, cols: int) -> DataFrame:
    """Correlation: convolution with the kernel turned by 180 degrees."""
    return conv2(m, np.asarray(kernel, float)[::-1, ::-1], "same", rows, cols)


def _per_series(df: DataFrame, groups: Sequence[str], order: Sequence[str], column: str, f, out: str) -> DataFrame:
    keys = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in groups)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(list(order), kind="stable")[column].to_numpy(float)
        r = f(x)
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] * len(next(iter(r.values()))) for g in groups}, **r})

    return df.select(*groups, *order, column).groupBy(*groups).applyInPandas(run, f"{keys}, {out}")


def fft(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str], n: int | None = None) -> DataFrame:
    """(groups, k, re, im) of each series, k from 1."""

    def one(x: np.ndarray) -> dict:
        z = np.fft.fft(x, n)
        return {"k": np.arange(1, len(z) + 1), "re": z.real, "im": z.imag}

    return _per_series(df, groups, order, column, one, "k long, re double, im double")


def ifft(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Real part of the inverse transform of (groups, k, re, im)."""
    keys = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in groups)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("k")
        z = np.fft.ifft(p["re"].to_numpy() + 1j * p["im"].to_numpy())
        return pd.DataFrame({**{g: [p[g].iloc[0]] * len(z) for g in groups}, "k": np.arange(1, len(z) + 1), "value": z.real})

    return df.groupBy(*groups).applyInPandas(run, f"{keys}, k long, value double")


def _iir(b: Sequence[float], a: Sequence[float], x: np.ndarray) -> np.ndarray:
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    n = max(len(a), len(b))
    b, a, z, y = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a))), np.zeros(n), np.empty(len(x))
    for k, v in enumerate(x):
        y[k] = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:] * v - a[1:] * y[k]
    return y


def iir(df: DataFrame, column: str, b: Sequence[float], a: Sequence[float], order: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Rational filter by its recurrence in each series."""
    return _per_series(df, groups, order, column, lambda x: {"k": np.arange(1, len(x) + 1), "y": _iir(b, a, x)}, "k long, y double")


def filtfilt(df: DataFrame, column: str, b: Sequence[float], a: Sequence[float], order: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Forward and backward, so without a phase shift."""
    return _per_series(df, groups, order, column, lambda x: {"k": np.arange(1, len(x) + 1), "y": _iir(b, a, _iir(b, a, x)[::-1])[::-1]}, "k long, y double")


def hilbert(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Analytic signal (re, im) and its envelope."""

    def one(x: np.ndarray) -> dict:
        n = len(x)
        h = np.zeros(n)
        h[0] = 1
        h[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            h[n // 2] = 1
        z = np.fft.ifft(np.fft.fft(x) * h)
        return {"k": np.arange(1, n + 1), "re": z.real, "im": z.imag, "envelope": np.abs(z)}

    return _per_series(df, groups, order, column, one, "k long, re double, im double, envelope double")


def periodogram(df: DataFrame, column: str, order: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """One-sided power spectral density at unit sample rate over angular frequency."""

    def one(x: np.ndarray) -> dict:
        n = len(x)
        p = np.abs(np.fft.rfft(x)) ** 2 / (2 * np.pi * n)
        p[1 : (n + 1) // 2] *= 2
        return {"k": np.arange(1, len(p) + 1), "power": p}

    return _per_series(df, groups, order, column, one, "k long, power double")


def deconv(y: Sequence[float], a: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    return np.polydiv(np.asarray(y, float), np.asarray(a, float))


def fir1(n: int, cutoff: float) -> np.ndarray:
    """Low-pass design with a Hamming window; cutoff in (0, 1) of half the sample rate."""
    k = np.arange(n + 1) - n / 2
    h = cutoff * np.sinc(cutoff * k) * np.hamming(n + 1)
    return h / h.sum()


def freqz(b: Sequence[float], a: Sequence[float] = (1.0,), n: int = 512) -> tuple[np.ndarray, np.ndarray]:
    w = np.arange(n) * np.pi / n
    z = np.exp(-1j * w)
    return np.polyval(np.asarray(b)[::-1], z) / np.polyval(np.asarray(a)[::-1], z), w
