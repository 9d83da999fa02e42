"""Kernels between uneven edges, and windows cut before far islands, against plain recomputations."""

import math

import numpy as np
import pytest

from showerlake.functions import kernels as kn
from showerlake.operators import frames as fr

SOURCES = [(-100.0, -60.0, 1.0), (-60.0, -55.0, 2.5), (-55.0, 0.0, 0.25), (0.0, 0.5, 4.0), (7.0, 7.0, 3.0), (500.0, 900.0, 1.5)]
EDGES = [-200.0, -90.0, -58.0, -57.0, 0.0, 0.25, 6.0, 30.0, 31.0, 700.0]


def spread(spark, sources, kernel):
    return {r["bin"]: r["v"] for r in kn.spread(spark.createDataFrame(sources, "lo double, hi double, v double"), EDGES, kernel).collect()}


@pytest.mark.parametrize("sigma", [0.3, 5.0, 120.0])
def test_gaussian(spark, sigma):
    got, want = spread(spark, SOURCES, kn.gaussian(sigma)), np.zeros(len(EDGES) + 1)
    x, w = np.polynomial.legendre.leggauss(400)
    for lo, hi, v in SOURCES:
        at = (lo + hi) / 2 + x * (hi - lo) / 2
        under = [float(np.sum(w / 2 * [0.5 * math.erfc((a - e) / sigma / math.sqrt(2)) for a in at])) for e in EDGES]
        want += v * np.diff([0.0, *under, 1.0])
    assert [got.get(b, 0.0) for b in range(-1, len(EDGES))] == pytest.approx(want, abs=1e-9 if sigma > 1 else 1e-5)
    assert sum(got.values()) == pytest.approx(sum(v for *_, v in SOURCES), rel=1e-12)


def test_tent(spark):
    got, want = spread(spark, SOURCES, kn.tent()), np.zeros(len(EDGES) + 1)
    for lo, hi, v in SOURCES:
        c, w = (lo + hi) / 2, hi - lo
        t = [(e - c) / w if w else (1.0 if e > c else -1.0) for e in EDGES]
        under = [0.0 if u <= -1 else 1.0 if u >= 1 else (1 + u) ** 2 / 2 if u <= 0 else 1 - (1 - u) ** 2 / 2 for u in t]
        want += v * np.diff([0.0, *under, 1.0])
    assert [got.get(b, 0.0) for b in range(-1, len(EDGES))] == pytest.approx(want, abs=1e-12)


def test_kernel_edges(spark):
    assert spread(spark, [(0.0, 1.0, None), (None, 1.0, 2.0), (2.0, None, 2.0)], kn.gaussian(1.0)) == {}
    assert spread(spark, [(-9e3, -8e3, 2.0), (8e3, 9e3, 3.0)], kn.gaussian(1.0)) == {-1: 2.0, len(EDGES) - 1: 3.0}
    with pytest.raises(ValueError):
        kn.spread(spark.createDataFrame(SOURCES, "lo double, hi double, v double"), [0.0, 0.0], kn.tent())


def caps(spark, rows, **kw):
    return {r["panel"]: r.asDict() for r in fr.cap_windows(spark.createDataFrame(rows, "panel string, i int, j int, e double"), **kw).collect()}


BULK = [("p", i, 0, 100.0) for i in range(-12, 12)]


def test_islands_are_cut(spark):
    far = [("p", i, 3, 1.5) for i in (40, 45, 50)]  # each under a thousandth of what is drawn, all three above it; 99.9 % are reached at bin 45
    got = caps(spark, BULK + far)["p"]
    assert (got["applied"], got["half_plain"], got["half"], got["components"], got["kept"]) == (1, 920.0, 240.0, 4, 1)
    assert (got["n_hi"], got["e_hi"], got["at_hi"], got["n_lo"], got["at_lo"]) == (3, 4.5, 70.0, 0, None)
    assert got["share_out"] == pytest.approx(4.5 / 2404.5)


def test_what_is_kept(spark):
    large = caps(spark, BULK + [("p", 50, 0, 40.0)])["p"]
    assert (large["applied"], large["half"], large["kept"]) == (0, 1020.0, 2)
    bridged = caps(spark, BULK + [("p", 12 + 3 * k, 0, 1.5) for k in range(5)])["p"]  # gaps of two bins are bridged
    assert (bridged["applied"], bridged["components"]) == (0, 1)
    small = caps(spark, [("s", 0, 0, 1.0), ("s", 30, 0, 0.0), ("s", 31, 0, None), *BULK])
    assert set(small) == {"s", "p"} and small["s"]["half"] == 200.0 and small["s"]["share_out"] == 0
    even = caps(spark, [("e", 5 * k, 0, 1.0) for k in range(1200)])["e"]  # all are islands, so all are kept
    assert even["components"] == even["kept"] == 1200
    assert caps(spark, [("z", 1, 1, 0.0)]) == {}


def test_islands(spark):
    rows = [(b, 1.0) for b in (-9, -8, -5, 0, 1, 3, 7)]
    got = sorted(tuple(r) for r in fr.islands(spark.createDataFrame(rows, "bin int, e double")).select("lo", "hi", "e").collect())
    assert got == [(-9, -8, 2.0), (-5, -5, 1.0), (0, 3, 3.0), (7, 7, 1.0)]
