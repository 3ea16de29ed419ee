from __future__ import annotations

import math

import numpy as np
import pytest

from tabulon.operators import numeric as n


def test_roots_and_integrals():
    assert n.fzero(math.cos, 1, 2) == pytest.approx(math.pi / 2)
    assert n.fminbnd(lambda x: (x - 2) ** 2, 0, 5) == pytest.approx(2, abs=1e-6)
    assert n.integral(math.sin, 0, math.pi) == pytest.approx(2)
    assert np.allclose(n.fsolve(lambda x: [x[0] ** 2 + x[1] - 3, x[0] - x[1] + 1], [1, 1]), [1, 2])
    x = np.linspace(0, 4, 30)
    assert np.allclose(n.lsqcurvefit(lambda p, x: p[0] * np.exp(-p[1] * x), [1, 1], x, 3 * np.exp(-0.5 * x)), [3, 0.5])
    t, y = n.ode45(lambda t, y: -y, (0, 2), [1.0])
    assert y[-1, 0] == pytest.approx(math.exp(-2), rel=1e-5) and t[-1] == 2


@pytest.mark.parametrize("k", [3, 4, 5, 6, 8, 10])
def test_magic(k):
    m = n.magic(k)
    s = k * (k * k + 1) // 2
    assert sorted(m.ravel()) == list(range(1, k * k + 1))
    assert set(m.sum(0)) | set(m.sum(1)) | {m.trace(), m[:, ::-1].trace()} == {s}


def test_curves():
    b, c = n.pchip([0, 1, 2, 4], [0, 1, 1, 5])
    v = [np.polyval(c[k], x - b[k]) for k, x in ((0, 0.0), (0, 1.0), (1, 1.5), (2, 4.0))]
    assert v == pytest.approx([0, 1, 1, 5])


def test_transfer_functions():
    g = n.TransferFunction([1], [1, 1])
    t = np.linspace(0, 10, 1001)
    assert np.allclose(g.step(t), 1 - np.exp(-t)) and np.allclose(g.impulse(t), np.exp(-t))
    assert g.dcgain() == 1 and g.isstable() and np.allclose(g.feedback().pole(), [-2])
    assert np.allclose(((g + g) * g / g - g).response([1.0]), g.response([1.0]))
    assert n.stepinfo(t, g.step(t), 1)["rise"] == pytest.approx(math.log(9), abs=0.02)
    k = n.lqr(np.array([[0.0, 1], [0, 0]]), np.array([[0.0], [1]]), np.eye(2), np.eye(1))
    assert np.allclose(k, [[1, math.sqrt(3)]])


def test_small(spark):
    assert n.nchoosek(5, 2) == 10 and len(n.perms([1, 2, 3])) == 6
    assert np.allclose(n.linkage(np.array([[0.0], [1], [5]]))[0], [1, 2, 1])
    assert [r.p for r in n.primes(spark, 20).orderBy("p").collect()] == [2, 3, 5, 7, 11, 13, 17, 19]
    tri = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0)], "t int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0)], "p int, x double, y double")
    assert {r.p: r.t for r in n.point_location(tri, pts, 1.0).collect()} == {1: 1, 2: None}
