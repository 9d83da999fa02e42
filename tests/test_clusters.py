"""Statistics over events as clusters against NumPy, and their odd cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerlake.operators import clusters as cl


def rows(spark, n=300, far=0.0, seed=3):
    rng = np.random.default_rng(seed)
    a = np.round(rng.uniform(-3, 3, n), 3)
    x = far + np.cos(a) + 0.3 * rng.normal(0, 1, n)
    b = a + 0.5 * rng.normal(0, 1, n)
    e = np.arange(n) // 2
    return spark.createDataFrame([(int(i), float(u), float(v), float(w)) for i, u, v, w in zip(e, x, a, b)], "event_number long, x double, a double, b double"), e, x, a, b


def r_of(x, a):
    c, s = np.cos(a), np.sin(a)
    xc, xs, cs = (np.corrcoef(u, v)[0, 1] for u, v in ((x, c), (x, s), (c, s)))
    return math.sqrt((xc**2 + xs**2 - 2 * xc * xs * cs) / (1 - cs**2))


def rc_of(a, b):
    u, v = (np.sin(z - np.arctan2(np.sin(z).mean(), np.cos(z).mean())) for z in (a, b))
    return (u * v).sum() / math.sqrt((u * u).sum() * (v * v).sum())


@pytest.mark.parametrize("far", [0.0, 1e7])
def test_circular_linear(spark, far):
    df, e, x, a, _ = rows(spark, far=far)
    [got] = cl.circular_linear(df.withColumn("k", F.lit(1)), ["k"], F.col("x"), F.col("a")).collect()
    left = np.array([r_of(x[e % 64 != g], a[e % 64 != g]) for g in range(64)])
    assert got["n"] == 300 and got["azimuths"] == len(set(a)) and got["groups"] == 64
    assert math.isclose(got["r"], r_of(x, a), rel_tol=1e-6) and math.isclose(got["se"], math.sqrt(63 * left.var()), rel_tol=1e-4)
    assert math.isclose(got["null_r2"], 2 / 299)


def test_circular_linear_gates(spark):
    make = lambda rs: spark.createDataFrame(rs, "k string, event_number long, x double, a double")
    few = [("few", i, float(i), float(i % 3)) for i in range(30)]
    still = [("still", i, 5.0, i / 10) for i in range(30)]
    lone = [("lone", 7, float(i), i / 10) for i in range(30)]
    line = [("line", i, float(i % 2), math.pi / 4 * (1 if i % 2 else -3) + 1e-8 * i) for i in range(30)]  # cosine equals sine
    none = [("gone", 1, None, 1.0), ("gone", 2, 1.0, None)]
    got = {r["k"]: r for r in cl.circular_linear(make(few + still + lone + line + none), ["k"], F.col("x"), F.col("a")).collect()}
    assert set(got) == {"few", "still", "lone", "line"}
    assert got["few"]["azimuths"] == 3 and got["few"]["r"] is None and got["few"]["se"] is None
    assert got["still"]["r"] is None and got["still"]["se"] is None
    assert got["lone"]["r"] > 0.9 and got["lone"]["se"] is None
    assert math.isclose(got["line"]["r"], 1.0, abs_tol=1e-6)
    assert cl.circular_linear(make([]), ["k"], F.col("x"), F.col("a")).count() == 0


def test_circular_circular(spark):
    df, e, _, a, b = rows(spark)
    df = df.withColumn("k", F.lit(1)).unionByName(spark.createDataFrame([(i, 0.0, 1.0, 0.1 * i) for i in range(9)], "event_number long, x double, a double, b double").withColumn("k", F.lit(2)))
    got = {r["k"]: r for r in cl.circular_circular(df, ["k"], F.col("a"), F.col("b")).collect()}
    z = np.arctanh([rc_of(a[e % 64 != g], b[e % 64 != g]) for g in range(64)])
    se = math.sqrt(63 * z.var())
    assert math.isclose(got[1]["r"], rc_of(a, b), rel_tol=1e-9) and math.isclose(got[1]["se_z"], se, rel_tol=1e-7)
    t = 1.959963984540054
    t += (t**3 + t) / (4 * 63) + (5 * t**5 + 16 * t**3 + 3 * t) / (96 * 63**2)
    assert math.isclose(got[1]["lo"], math.tanh(np.arctanh(got[1]["r"]) - t * se), rel_tol=1e-7)
    assert got[2]["r"] is None and got[2]["lo"] is None


def test_ratios(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("a", 0, 5), ("one", 1, 2), ("void", 0, 0), ("void", 0, 0), ("sure", 4, 4), ("sure", 2, 2), (None, 1, 4)], "k string, u int, v int")
    got = {r["k"]: r for r in cl.ratios(df, ["k"], {"s": (F.col("u"), F.col("v"))}, F.max("v").alias("most")).collect()}
    u, v = np.array([1, 3, 0]), np.array([2, 4, 5])
    se = math.sqrt(((u - 4 / 11 * v) ** 2).sum() * 3 / 2) / 11
    assert math.isclose(got["a"]["s"], 4 / 11) and math.isclose(got["a"]["s_se"], se) and got["a"]["s_lo"] == 0.0 and got["a"]["s_hi"] == 1.0 and got["a"]["most"] == 5
    assert got["one"]["s"] == 0.5 and got["one"]["s_se"] is None and got["one"]["s_lo"] is None and got["one"]["s_hi"] is None
    assert got["void"]["s"] is None and got["void"]["s_se"] is None and got["void"]["s_hi"] is None
    assert (got["sure"]["s"], got["sure"]["s_lo"], got["sure"]["s_hi"]) == (1.0, 1.0, 1.0) and got[None]["s"] == 0.25


def test_profile_curves(spark):
    prof = spark.createDataFrame([(1, 0, 0, -1, 2.0, 2.0), (1, 0, 0, 3, 6.0, 0.0), (1, 1, 0, 3, 5.0, 0.0), (2, 0, 0, 3, 1.0, 0.0), (2, 0, 0, 4, 3.0, 0.0), (3, 0, 0, -1, 4.0, 4.0)], "event_number long, b int, axis int, bin int, e double, e_neg double")
    showers = spark.createDataFrame([(1, 0, 8.0), (1, 1, 5.0), (2, 0, 4.0), (3, 0, 4.0)], "event_number long, b int, e_own double")
    got = {(r["axis"], r["bin"]): r for r in cl.profile_curves(prof, showers).collect()}
    f = np.array([0.75, 1.0, 0.25, 0.0])
    assert math.isclose(got[0, 3]["mean"], f.mean()) and math.isclose(got[0, 3]["sd"], f.std(ddof=1)) and math.isclose(got[0, 3]["pooled"], 12 / 21)
    c, m = np.array([1.75, 0.25, 0.0]), np.array([2, 1, 1])
    half = 4.302653 * math.sqrt(1.5 * ((c - f.mean() * m) ** 2).sum()) / 4
    assert math.isclose(got[0, 3]["hi"] - got[0, 3]["mean"], half, rel_tol=1e-9)
    kept = {(r["axis"], r["bin"]): r for r in cl.profile_curves(prof, showers, drop_negative=True).collect()}
    assert kept[0, -1]["mean"] == 0.0 and math.isclose(kept[0, 3]["mean"], (1 + 1 + 0.25) / 3) and math.isclose(kept[0, 3]["pooled"], 12 / 15)  # event 3 keeps nothing
    one = cl.profile_curves(prof.filter("event_number = 2"), showers.filter("event_number = 2")).filter("bin = 4").first()
    assert one["mean"] == 0.75 and one["sd"] is None and one["lo"] is None and one["pooled_hi"] is None
    assert cl.profile_curves(prof.filter("b > 5"), showers.filter("b > 5")).count() == 0


def test_mean_direction(spark):
    a = np.concatenate([np.linspace(3.0, 3.3, 40), [3.1]])
    df = spark.createDataFrame([("many", float(v)) for v in a] + [("few", float(v)) for v in a[:10]] + [("void", None)], "k string, a double")
    got = {r["k"]: r for r in cl.mean_direction(df, ["k"], F.col("a")).collect()}
    z = np.exp(1j * a).mean()
    se = math.sqrt((1 - np.cos(2 * (a - np.angle(z))).mean()) / (2 * abs(z) ** 2) / len(a))
    assert math.isclose(got["many"]["mean"], np.angle(z), rel_tol=1e-9) and math.isclose(got["many"]["se"], se, rel_tol=1e-7)
    assert math.isclose(got["many"]["hi"] - got["many"]["mean"], math.asin(1.959963984540054 * se), rel_tol=1e-7)
    assert got["few"]["se"] is None and got["few"]["lo"] is None and got["few"]["sd"] > 0 and "void" not in got


def test_residual_and_seg_cards_of_small_selections(spark):
    s = spark.createDataFrame([(0, 10.0, 4.0, 5.0, 0.1, 0.2), (0, None, 6.0, 5.0, 0.3, 0.2), (1, 60.0, None, 5.0, None, 0.2)], "b int, d double, energy_pred double, p double, angle_pred double, theta double")
    got = {(r["b"], r["slice"], r["kind"]): r for r in cl.residual_cards(s).collect()}
    assert set(got) == {(0, k, m) for k in ("all", "0") for m in ("energy", "angle")}
    assert got[0, "all", "energy"]["n"] == 2 and math.isclose(got[0, "all", "energy"]["rmse"], 1.0) and got[0, "0", "energy"]["sd"] is None and got[0, "0", "energy"]["r_lo"] is None
    e = spark.createDataFrame([(None, 4, 3, 0, 0, 0, 1.0, 1.0, 1.0, 2.0)], "d double, n_hits long, n_correct long, n_true long, n_pred long, n_tp long, abs_err double, wabs_err double, sq_err double, e_dep double")
    cards = {(r["slice"], r["card"]): r for r in cl.seg_cards(e).collect()}
    assert {k for k, _ in cards} == {"all"} and cards["all", "accuracy"]["value"] == 0.75 and cards["all", "accuracy"]["lo"] is None
    assert cards["all", "precision"]["value"] is None and cards["all", "rmse"]["value"] == 0.5
