"""The estimators against values of printed tables and direct computations, on groups of 1, 2, 7, 8, 14, 15, 19, 20 and 200."""

import inspect

import numpy as np
from pyspark.sql import functions as F

from showerlake.functions import estimates as es


def test_bootstrap(spark):
    assert inspect.signature(es.bootstrap).parameters["replicates"].default == 2_000
    x = np.random.default_rng(2).normal(10, 2, 200)
    rows = [(k, i, float(v)) for k, n in (("a", 200), ("b", 19), ("c", 20), ("d", 1)) for i, v in enumerate(x[:n])]
    rows += [("b", 900, None), ("b", 901, float("nan"))]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = {r["k"]: r for r in es.bootstrap(df, ["k"], "v", F.col("v") - 10, replicates=400).collect()}
    assert {k: r["n"] for k, r in got.items()} == {"a": 200, "b": 19, "c": 20, "d": 1}
    for stat in ("", "width_", "rmse_"):
        assert got["b"][stat + "lo"] is None and got["b"][stat + "hi"] is None and got["b"][stat + "se"] > 0
        assert got["d"][stat + "se"] is None and got["d"][stat + "lo"] is None
        assert got["c"][stat + "lo"] < got["c"][stat + "hi"]
    drawn = np.random.default_rng(3).choice(x, (4000, 200))
    q = np.percentile(drawn, [25, 50, 75], axis=1)
    for stat, want in (("", q[1]), ("width_", (q[2] - q[0]) / 1.349 / q[1]), ("rmse_", np.sqrt(((drawn - 10) ** 2).mean(1)))):
        lo, hi = np.quantile(want, [0.025, 0.975])
        assert abs(got["a"][stat + "lo"] - lo) < 0.25 * (hi - lo) and abs(got["a"][stat + "hi"] - hi) < 0.25 * (hi - lo)


LADDER = (1, 2, 7, 8, 14, 15, 19, 20, 200)


def ladder(spark):
    rng = np.random.default_rng(7)
    groups = {n: np.concatenate([rng.normal(10, 2, n - n // 10), rng.normal(30, 9, n // 10)]) for n in LADDER}
    rows = [(n, i, float(v)) for n, x in groups.items() for i, v in enumerate(x)]
    return groups, spark.createDataFrame(rows, "g int, i int, v double")


def by_group(df):
    return {r["g"]: r for r in df.collect()}


def test_tables():
    # Printed tables of chi-square at 0.975 and 0.025.
    for nu, hi, lo in ((1, 5.0239, 0.00098207), (2, 7.3778, 0.050636), (5, 12.8325, 0.83121), (10, 20.4832, 3.24697), (30, 46.9792, 16.7908)):
        assert abs(es.chi2_table(0.975)[nu - 1] - hi) < 6e-5 and abs(es.chi2_table(0.025)[nu - 1] - lo) < 1e-4 * lo + 1e-8
    # The sign test's table: the largest j with an interval of 95 % at least.
    for n, j in ((6, 1), (8, 1), (9, 2), (12, 3), (15, 4), (20, 6), (25, 8), (30, 10), (50, 18), (100, 40)):
        assert es.median_ranks()[n] == j


def test_intervals_of_sigma(spark):
    groups, df = ladder(spark)
    got = by_group(es.gauss(df, ["g"], "v"))
    known = {2: (5.0239, 0.00098207), 7: (14.4494, 1.23734), 8: (16.0128, 1.68987), 20: (32.8523, 8.90652)}
    for n, x in groups.items():
        r = got[n]
        assert r["n"] == n and abs(r["mu"] - x.mean()) < 1e-9
        if n == 1:
            assert r["s"] is None and r["s_lo"] is None and r["mu_lo"] is None and r["se"] is None
            continue
        s = x.std(ddof=1)
        assert abs(r["s"] - s) < 1e-9 and r["s_lo"] < s < r["s_hi"] and r["mu_lo"] < x.mean() < r["mu_hi"]
        if n in known:
            assert abs(r["s_lo"] / (s * np.sqrt((n - 1) / known[n][0])) - 1) < 1e-4 and abs(r["s_hi"] / (s * np.sqrt((n - 1) / known[n][1])) - 1) < 1e-4
        assert (r["robust"] is None) == (r["far"] is None) == (n < 20)
        if n >= 20:
            q = np.percentile(x, [25, 75])
            assert abs(r["robust"] - (q[1] - q[0]) / 1.349) < 1e-9 and r["far"] == int(abs(r["robust"] - s) / s > 0.15)


def test_core_refit(spark):
    groups, df = ladder(spark)
    got = by_group(es.core_refit(df, ["g"], "v"))
    for n, x in groups.items():
        mu, w, k, rounds = x.mean(), x.std(ddof=1) if n > 1 else None, n, 0
        while n >= 15 and rounds < 16:
            core = x[(x >= mu - 2.5 * w) & (x <= mu + 2.5 * w)]
            if len(core) < 15:
                break
            rounds, mu, before, w, k = rounds + 1, core.mean(), w, core.std(ddof=1), len(core)
            if abs(w - before) <= 1e-7 * before:
                break
        r = got[n]
        assert (r["n"], r["rounds"], r["cut"], r["applied"]) == (k, rounds, int(k < n), int(rounds > 0)) and abs(r["mu"] - mu) < 1e-9
        assert r["s"] is None if n == 1 else abs(r["s"] - (w / 0.9365574133 if k < n else w)) < 1e-9
    assert any(r["cut"] for r in got.values()) and es.core_refit(df.limit(0), ["g"], "v").count() == 0


def test_median_order_interval(spark):
    groups, df = ladder(spark)
    got = by_group(es.median_order_ci(df, ["g"], "v"))
    assert set(got) == {n for n in LADDER if n >= 6}
    for n, j in ((7, 1), (8, 1), (14, 3), (15, 4), (19, 5), (20, 6), (200, 86)):
        x = np.sort(groups[n])
        assert (got[n]["lo"], got[n]["hi"]) == (x[j - 1], x[n - j])


def test_robust_width_and_circular(spark):
    groups, df = ladder(spark)
    big = np.random.default_rng(1).normal(5, 1, 400)
    more = df.unionByName(spark.createDataFrame([(400, i, float(v)) for i, v in enumerate(big)] + [(25, i, -1.0 - i) for i in range(25)] + [(301, i, 2.0) for i in range(301)], "g int, i int, v double"))
    got = by_group(es.robust_width(more, ["g"], "v"))
    for n, r in got.items():
        assert (r["width"] is None) == (n < 20 or n == 25) and (r["tail"] is None) == (n < 300 or n == 301)
    q = np.percentile(big, [25, 50, 75])
    assert abs(got[400]["tail"] - np.mean(np.abs(big - q[1]) > 3 * (q[2] - q[0]) / 1.349)) < 1e-12
    found = by_group(es.robust_width(df.filter("g >= 20"), ["g"], "v", error=True))
    assert found[200]["width_lo"] < found[200]["width"] < found[200]["width_hi"]
    around = by_group(es.circular(df, ["g"], "v"))
    assert around[1]["rayleigh_p"] is None and abs(around[1]["r"] - 1) < 1e-12 and around[2]["rayleigh_p"] is not None


def test_histogram_and_density(spark):
    groups, df = ladder(spark)
    h = es.histogram(df, ["g"], "v", 5.0, 20.0, 30).collect()
    for n, x in groups.items():
        want = np.histogram(x[(x >= 5) & (x <= 20)], bins=np.linspace(5, 20, 31), density=True)[0]
        mine = {r["bin"]: r for r in h if r["g"] == n}
        assert sum(r["n"] for r in mine.values()) == n and all(r["density"] is None for k, r in mine.items() if k in (-1, 30))
        assert all(abs((mine[k]["density"] if k in mine else 0) - w) < 1e-9 for k, w in enumerate(want) if not np.isnan(w))
    flat = spark.createDataFrame([(50, i, 3.0) for i in range(50)], "g int, i int, v double")
    got = es.kde(df.unionByName(flat), ["g"], "v", 0.0, 40.0, points=60).collect()
    assert {r["g"] for r in got} == {n for n in LADDER if n >= 8}
    for n, x in groups.items():
        if n < 8:
            continue
        q = np.percentile(x, [25, 75])
        b = 0.9 * min(x.std(ddof=1), (q[1] - q[0]) / 1.349) * n**-0.2
        for r in (r for r in got if r["g"] == n):
            want = np.exp(-0.5 * ((r["at"] - x) / b) ** 2).sum() / (n * b * np.sqrt(2 * np.pi))
            assert abs(r["density"] - want) < 0.01 / b  # linear binning, and the kernel's end at 4 h
