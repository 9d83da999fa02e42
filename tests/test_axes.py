"""Planned axes: ticks, scales, steps of lattices and counts on them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerlake.operators import axes as ax

SCHEMA = "feature string, label int, value double"


@pytest.mark.parametrize(("lo", "hi", "want"), [
    (0.3, 9.7, (0.0, 10.0, 1.0)), (-0.031, 0.052, (-0.04, 0.06, 0.01)), (0.0, 0.12, (0.0, 0.12, 0.01)), (101.0, 1290.0, (100.0, 1300.0, 100.0)), (0.3, 0.5, (0.3, 0.5, 0.02)),
    (5.0, 5.0, (0.0, 1.0, 0.2)), (2.0, 1.0, (0.0, 1.0, 0.2)), (None, 3.0, (0.0, 1.0, 0.2)), (0.0, 13.0, (0.0, 14.0, 2.0)),
])
def test_nice_range(spark, lo, hi, want):
    df = spark.createDataFrame([(lo, hi)], "lo double, hi double")
    assert tuple(df.select(*ax.nice_range(F.col("lo"), F.col("hi"))).first()) == pytest.approx(want)


def plan(spark, rows, *a):
    return {r["feature"]: r.asDict() for r in ax.plan_axes(spark.createDataFrame(rows, SCHEMA), *a).collect()}


def test_steps(spark):
    v = [("a", 0, x) for x in (102.5, 553.5, 861.0)] + [("b", 0, x) for x in (0.0, 6.0, 10.0)] + [("c", 0, x) for x in (0.0, 0.4, 5.0)] + [("d", 0, 7.0)] + [("e", 0, float(x)) for x in (3, 4, 9)] + [("f", 0, x) for x in (0.0, 1.5)]
    got = {r["feature"]: r.asDict() for r in ax.lattice_steps(spark.createDataFrame(v, SCHEMA), {"a": None, "b": None, "c": None, "d": None, "e": 1.0, "f": 1.0}).collect()}
    assert {f: (round(r["step"], 6), r["verified"]) for f, r in got.items()} == {"a": (20.5, 1), "b": (2.0, 1), "e": (1.0, 1), "f": (1.0, 0)}


def test_scales_and_classes(spark):
    rng = np.random.default_rng(3)
    wide, flat = np.exp(rng.normal(0, 2, 400)), rng.uniform(40, 60, 400)
    rows = [("wide", i % 2, float(x)) for i, x in enumerate(wide)] + [("flat", i % 2, float(x)) for i, x in enumerate(flat)]
    rows += [("flat", 2, 1e6)] * 14 + [("wide", 0, None), ("wide", 0, math.nan), ("wide", 0, math.inf)] + [("few", 0, float(x)) for x in range(1, 9)] + [("floor", 0, 1e-6)] * 100 + [("floor", 0, 5.0 + x) for x in range(20)]
    rows += [("sides", 0, float(x)) for x in rng.normal(0, 1, 100)] + [("only", 0, 1e-6)] * 20 + [("layers", None, 20.5 * (x % 9) + 10.0) for x in range(200)]
    got = plan(spark, rows, {"layers": None}, ("sides",))
    assert {f: (r["scale"], r["provisional"]) for f, r in got.items()} == {"wide": ("log", 0), "flat": ("linear", 0), "few": ("linear", 1), "floor": ("linear", 0), "sides": ("linear", 0), "only": ("linear", 0), "layers": ("linear", 0)}
    assert got["wide"]["decades"] == pytest.approx(math.log10(np.percentile(wide, 99) / np.percentile(wide, 1)))
    assert (got["flat"]["lo"], got["flat"]["bins"], got["flat"]["lo"] + got["flat"]["bins"] * got["flat"]["width"]) == (40.0, math.ceil(2 * 200 ** (1 / 3)), pytest.approx(60.0))
    assert got["floor"]["lo"] >= 4 and got["few"]["bins"] == 8 and got["sides"]["decades"] is None
    assert (got["only"]["lo"], got["only"]["interval"]) == (0.0, 0.2)
    lat = got["layers"]
    assert lat["step"] == pytest.approx(20.5) and lat["width"] == pytest.approx(20.5 * lat["steps"])
    assert ((lat["lo"] - 10.0) / 20.5) % 1 == pytest.approx(0.5)


def test_counts(spark):
    rows = [("a", i % 2, float(x)) for i, x in enumerate(np.linspace(1, 20, 100))] + [("a", 0, -50.0), ("a", 1, 900.0), ("a", 1, None)] + [("w", 0, 10.0 ** float(x)) for x in np.linspace(-2, 2, 60)] + [("w", 0, 0.0), ("w", None, 1e9)]
    df = spark.createDataFrame(rows, SCHEMA)
    p = ax.plan_axes(df)
    axes = {r["feature"]: r.asDict() for r in p.collect()}
    got = {(r["feature"], r["label"], r["bin"]): r["n"] for r in ax.planned_hist(df, p).collect()}
    want = {}
    for f, c, v in rows:
        if v is None:
            continue
        a = axes[f]
        x = v if a["scale"] == "linear" else math.log10(v) if v > 0 else None
        end = a["lo"] + a["bins"] * a["width"]
        b = -2 if x is None else -1 if x < a["lo"] else a["bins"] if x > end else min(a["bins"] - 1, math.floor((x - a["lo"]) / a["width"]))
        want[f, c, b] = want.get((f, c, b), 0) + 1
    assert axes["w"]["scale"] == "log" and got == want


def test_empty(spark):
    assert plan(spark, []) == {} and plan(spark, [("a", 0, None)], {"a": None}) == {}
