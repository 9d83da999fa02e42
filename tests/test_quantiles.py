"""Quantiles by selection and the bootstrap over them, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerlake.functions import estimates as es
from showerlake.functions import quantiles as qs

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def groups():
    rng = np.random.default_rng(5)
    return {
        "normal": rng.standard_normal(3_000), "ties": np.repeat([1.0, 2.0, 2.0, 5.0], 400), "one": np.array([7.0]), "two": np.array([3.0, -1.0]), "outlier": np.append(rng.uniform(0, 1, 999), 1e300),
        "wide": np.concatenate([-(10.0 ** rng.uniform(-9, 9, 300)), 10.0 ** rng.uniform(-9, 9, 300)]), "ends": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 1.0 + 2**-52]), "tiny": np.array([5e-324, 1e-323, 0.0, 2e-323]), None: rng.exponential(1, 500),
    }


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, float(v), i) for k, vs in groups().items() for i, v in enumerate(vs)]
    odd = [("normal", None, 0), ("normal", float("nan"), 0), ("normal", float("inf"), 0), ("empty", None, 0)]
    return spark.createDataFrame(data + odd, "k string, v double, i int").repartition(3)


@pytest.mark.parametrize("small, bins", [(0, 65_536), (0, 16), (700, 64), (10_000, 65_536)])
def test_quantiles(rows, small, bins):
    got = {r["k"]: r for r in qs.quantiles(rows, ["k"], {"q": (F.col("v"), PROBS), "m": (-F.col("v"), [0.5])}, small=small, bins=bins).collect()}
    assert set(got) == set(groups())
    for k, vs in groups().items():
        want = [np.quantile(vs / 2, p) * 2 for p in PROBS]
        assert np.allclose(got[k]["q"], want, rtol=1e-12, atol=1e-320) and np.allclose(got[k]["m"], [-np.quantile(vs / 2, 0.5) * 2], rtol=1e-12, atol=1e-320), k


def test_weighted_and_beside_other_columns(rows):
    some = rows.filter("k = 'normal' OR k = 'ties' OR k = 'empty' OR k IS NULL").withColumn("w", F.col("i") % 4)
    got = {r["k"]: r for r in qs.with_quantiles(some.groupBy("k").agg(F.count("*").alias("n")), some, ["k"], {"q": ("v", [0.25, 0.5]), "m": (F.col("v") * 2, 0.9)}, F.col("w"), small=0).collect()}
    assert got["empty"]["q"] is None and got["empty"]["m"] is None and got["empty"]["n"] == 1
    for k in ("normal", "ties", None):
        vs = np.repeat(groups()[k], np.arange(len(groups()[k])) % 4)
        assert np.allclose(got[k]["q"], np.quantile(vs, [0.25, 0.5])) and np.isclose(got[k]["m"], 2 * np.quantile(vs, 0.9)), k


def test_without_keys_and_empty(rows):
    assert np.isclose(qs.quantiles(rows.filter("k = 'normal'"), [], {"q": (F.col("v"), [0.3])}, small=0).first()["q"][0], np.quantile(groups()["normal"], 0.3))
    none = rows.filter("k = 'empty'")
    assert qs.quantiles(none, ["k"], {"q": (F.col("v"), [0.5])}).count() == 0
    assert qs.with_quantiles(none.agg(F.count("v").alias("n")), none, [], {"m": ("v", 0.5)}).collect()[0].asDict() == {"n": 0, "m": None}


def test_no_task_holds_the_values_of_a_key(rows):
    """Only bins meet: every aggregate over values has a partial one before its shuffle, and windows stand over bins."""
    plan = qs.quantiles(rows, ["k"], {"q": (F.col("v"), [0.5])}, small=0)._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_bootstrap_is_as_wide_as_a_sampled_one(spark):
    rng = np.random.default_rng(8)
    data = {"a": rng.normal(10, 2, 4_000), "b": rng.exponential(3, 900), "few": rng.normal(5, 1, 25), "tied": np.round(rng.normal(10, 2, 600))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("small", 1.0)] * 5 + [("none", None)], "k string, v double").repartition(3)
    got = {r["k"]: r for r in es.bootstrap(df, ["k"], "v", F.col("v") - 9).collect()}
    for k, vs in data.items():
        draws = rng.choice(vs, (4_000, len(vs)))
        q1, q2, q3 = np.quantile(draws, [0.25, 0.5, 0.75], axis=1)
        width, rmse = (q3 - q1) / es.ROBUST / q2, np.sqrt(((draws - 9) ** 2).mean(1))
        for name, x in (("", q2), ("width_", width), ("rmse_", rmse)):
            sd, (lo, hi), coarse = x.std(ddof=1), np.quantile(x, [0.025, 0.975]), 0.1 if k == "tied" else 0
            assert abs(got[k][f"{name}se"] - sd) <= 0.12 * sd, (k, name)
            assert abs(got[k][f"{name}lo"] - lo) < 0.35 * sd + coarse and abs(got[k][f"{name}hi"] - hi) < 0.35 * sd + coarse, (k, name)
        assert got[k]["n"] == got[k]["n_rmse"] == len(vs)
    assert got["small"]["lo"] is None and got["small"]["se"] == 0 and got["none"]["n"] == 0 and got["none"]["se"] is None
