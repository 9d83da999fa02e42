"""Estimators and intervals, as columns over aggregates and as aggregates by key."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import quantiles as qs
from .quantiles import with_quantiles

# 0.975 quantiles of Student's t for 1 to 30 degrees of freedom.
T975 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450,
    2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)
Z = 1.959963984540054
ROBUST = 1.349
# Least rows of a curve, of the core refit and of robust numbers; the core's half-width in sigmas, its rounds
# and what a cut there leaves of a Gaussian's sigma; how far the robust width may be from sigma.
LEAST_CURVE, LEAST_CORE, LEAST_ROBUST = 8, 15, 20
CORE_WIDTH, CORE_ROUNDS, CORE_FACTOR = 2.5, 16, 0.9365574133
FAR_TOLERANCE = 0.15
#: Groups up to this size look up the exact rank of the median's interval.
RANKED = 1_000


def t975(nu: Column) -> Column:
    """Quantile of t: the table, and beyond it the expansion in 1 / nu about the normal one."""
    v = nu.cast("double")
    far = F.lit(Z) + (Z**3 + Z) / (4 * v) + (5 * Z**5 + 16 * Z**3 + 3 * Z) / (96 * v * v)
    return F.when(nu < 1, None).when(nu <= 30, F.get(F.array(*[F.lit(x) for x in T975]), (nu - 1).cast("int"))).otherwise(far)


@lru_cache(None)
def chi2_table(p: float, most: int = 30) -> tuple[float, ...]:
    """Quantiles of chi-square for 1 to `most` degrees of freedom: bisection on the series of its distribution."""

    def below(x: float, nu: int) -> float:
        a, y = nu / 2, x / 2
        term = total = 1.0
        k = 0
        while term > 1e-17 * total:
            k += 1
            term *= y / (a + k)
            total += term
        return math.exp(a * math.log(y) - y - math.lgamma(a + 1)) * total

    out = []
    for nu in range(1, most + 1):
        lo, hi = 1e-9, 10.0 * nu + 20
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if below(mid, nu) < p else (lo, mid)
        out.append((lo + hi) / 2)
    return tuple(out)


def chi2_quantile(nu: Column, upper: bool) -> Column:
    """The 0.975 (upper) or 0.025 quantile: exact to 30 degrees of freedom, Wilson-Hilferty's cube beyond."""
    v, z = nu.cast("double"), Z if upper else -Z
    far = v * F.pow(1 - 2 / (9 * v) + z * F.sqrt(2 / (9 * v)), 3)
    known = chi2_table(0.975 if upper else 0.025)
    return F.when(nu < 1, None).when(nu <= 30, F.get(F.array(*[F.lit(x) for x in known]), (nu - 1).cast("int"))).otherwise(far)


def t_interval(mean: Column, sd: Column, n: Column) -> tuple[Column, Column]:
    half = t975(n - 1) * sd / F.sqrt(n)
    return mean - half, mean + half


def chi2_interval(sd: Column, n: Column) -> tuple[Column, Column]:
    """Of a standard deviation; none for one value."""
    nu = n - 1
    return sd * F.sqrt(nu / chi2_quantile(nu, True)), sd * F.sqrt(nu / chi2_quantile(nu, False))


def c4(n: Column) -> Column:
    """Bias of the standard deviation of n values: a table to 30, then its expansion."""
    known = [math.sqrt(2 / (k - 1)) * math.exp(math.lgamma(k / 2) - math.lgamma((k - 1) / 2)) for k in range(2, 31)]
    return F.when(n < 2, None).when(n <= 30, F.get(F.array(*[F.lit(x) for x in known]), (n - 2).cast("int"))).otherwise(1 - 1 / (4.0 * n) - 7 / (32.0 * n * n))


def gauss(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Moments of each group with errors and intervals, from two values on; from LEAST_ROBUST on the robust width and
    whether it is far from sigma."""
    by = df.groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mu"), F.stddev_samp(col).alias("s"), F.stddev_pop(col).alias("s0"))
    by = with_quantiles(by, df, keys, {"qs": (col, [0.25, 0.5, 0.75])})
    by = by.withColumns({"median": F.get("qs", F.lit(1)), "robust": F.when(F.col("n") >= LEAST_ROBUST, (F.get("qs", F.lit(2)) - F.get("qs", F.lit(0))) / ROBUST)}).drop("qs")
    lo, hi = t_interval(F.col("mu"), F.col("s"), F.col("n"))
    s_lo, s_hi = chi2_interval(F.col("s"), F.col("n"))
    gate = lambda x, least: F.when(F.col("n") >= least, x)
    return by.withColumns({
        "mu_lo": lo, "mu_hi": hi, "s_lo": s_lo, "s_hi": s_hi, "s_unbiased": F.col("s") / c4(F.col("n")), "se": gate(F.col("s") / F.sqrt("n"), 2), "resolution": F.try_divide("s", "mu"),
        "resolution_se": gate(F.abs(F.try_divide(F.col("s"), F.col("mu"))) * F.sqrt(1 / (2.0 * (F.col("n") - 1)) + F.try_divide(F.col("s") ** 2, F.col("n") * F.col("mu") ** 2)), 2),
        "far": gate(((F.col("s") > 0) & (F.col("robust") > 0) & (F.abs(F.col("s") - F.col("robust")) > FAR_TOLERANCE * F.col("s"))).cast("int"), LEAST_ROBUST),
    })


def core_refit(df: DataFrame, keys: list[str], col: str, width: float = CORE_WIDTH, rounds: int = CORE_ROUNDS, factor: float = CORE_FACTOR, least: int = LEAST_CORE) -> DataFrame:
    """Moments inside mu +- width * sigma, again until sigma settles: mu, s, n (inside), rounds, cut, applied.

    A round is one aggregate over the groups that are still open, and its result is written, so that the next one starts
    there. The window is the raw sigma; `factor` makes up for the cut at the end, if rows were cut. Groups of under
    `least` rows, or without a width, keep their plain moments. Rows whose key is null belong to no group."""
    rows = df.select(*keys, F.col(col).cast("double").alias("_v")).filter("_v IS NOT NULL")
    m = rows.groupBy(*keys).agg(F.count("*").alias("all"), F.avg("_v").alias("mu"), F.stddev_samp("_v").alias("s"))
    m = m.withColumns({"n": F.col("all"), "rounds": F.lit(0), "open": F.coalesce((F.col("all") >= least) & (F.col("s") > 0), F.lit(False))})
    m = written(m, "core")
    for _ in range(rounds):
        if m.filter("open").isEmpty():
            break
        window = m.filter("open").select(*keys, (F.col("mu") - width * F.col("s")).alias("_lo"), (F.col("mu") + width * F.col("s")).alias("_hi"))
        inside = rows.join(window, keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        met = m.join(inside.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("_v").alias("_mu"), F.stddev_samp("_v").alias("_s")), keys, "left")
        go = F.coalesce(F.col("open") & (F.col("_n") >= least) & (F.col("_s") > 0), F.lit(False))
        settled = F.abs(F.col("_s") - F.col("s")) <= 1e-7 * F.greatest(F.col("s"), F.lit(1e-12))
        take = lambda new, old: F.when(go, F.col(new)).otherwise(F.col(old)).alias(old)
        m = written(met.select(*keys, "all", take("_mu", "mu"), take("_s", "s"), take("_n", "n"), (F.col("rounds") + go.cast("int")).alias("rounds"), (go & ~settled).alias("open")), "core")
    cut = F.col("n") < F.col("all")
    return m.select(*keys, "n", "mu", F.when(cut, F.col("s") / factor).otherwise(F.col("s")).alias("s"), "rounds", cut.cast("int").alias("cut"), (F.col("rounds") > 0).cast("int").alias("applied"))


def ratio_ci(df: DataFrame, keys: list[str], num: Column, den: Column) -> DataFrame:
    """Sum over sum by group, with the error of clusters (rows) from five sums."""
    c = F.col
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(num).alias("_u"), F.sum(den).alias("_v"), F.sum(num * num).alias("_uu"), F.sum(num * den).alias("_uv"), F.sum(den * den).alias("_vv"))
    by = by.withColumn("ratio", F.try_divide("_u", "_v"))
    spread = F.greatest(F.lit(0.0), c("_uu") - 2 * c("ratio") * c("_uv") + c("ratio") ** 2 * c("_vv"))
    by = by.withColumn("se", F.try_divide(F.sqrt(spread * F.try_divide(c("n"), c("n") - 1)), F.abs("_v")))
    half = t975(c("n") - 1) * c("se")
    return by.withColumns({"lo": c("ratio") - half, "hi": c("ratio") + half}).drop("_u", "_v", "_uu", "_uv", "_vv")


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = k / n, Z * Z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return mid - half, mid + half


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of the rows that have both, as an aggregate; none where either has no spread (`corr` fails there)."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def fisher_ci(r: Column, n: Column) -> tuple[Column, Column]:
    z, half = F.atanh(r), F.lit(Z) / F.sqrt(n - 3)
    return F.when(n > 3, F.tanh(z - half)), F.when(n > 3, F.tanh(z + half))


def mae_rmse(df: DataFrame, keys: list[str], err: Column) -> DataFrame:
    """Mean absolute error with a t-interval, root mean square error with the interval of its mean square."""
    by = df.groupBy(*keys).agg(F.count(err).alias("n"), F.avg(F.abs(err)).alias("mae"), F.stddev_samp(F.abs(err)).alias("s_abs"), F.avg(err * err).alias("mse"), F.stddev_samp(err * err).alias("s_sq"), F.avg(err).alias("bias"))
    lo, hi = t_interval(F.col("mae"), F.col("s_abs"), F.col("n"))
    mlo, mhi = t_interval(F.col("mse"), F.col("s_sq"), F.col("n"))
    return by.withColumns({"mae_lo": lo, "mae_hi": hi, "rmse": F.sqrt("mse"), "rmse_lo": F.sqrt(F.greatest(F.lit(0.0), mlo)), "rmse_hi": F.sqrt(mhi)})


#: Bins of the squares that an RMSE's replicates are drawn from.
SQUARE_BINS = 4096


def _drawn_ranks(replicates: int, seed: int):
    """For each group of n values and each replicate, the ranks (from 0) in the group that the replicate's order statistics about its quartiles have.

    The order statistics of n draws with replacement are those of n uniforms, times n; their joint law comes from sums of exponentials."""

    def step(batches):
        for b in batches:
            keys, reps, ts, ranks = [], [], [], []
            for i, (n, h) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                at = sorted({int(f(p * (n - 1))) for p in (0.25, 0.5, 0.75) for f in (math.floor, math.ceil)})
                steps = np.diff([0, *(r + 1 for r in at), n + 1]).astype(float)
                sums = np.random.default_rng([seed, h & (1 << 64) - 1]).standard_gamma(steps, (replicates, len(steps))).cumsum(1)
                found = np.minimum((sums[:, :-1] / sums[:, -1:] * n).astype(np.int64), n - 1)
                keys.append(np.full(found.size, i))
                reps.append(np.repeat(np.arange(replicates), len(at)))
                ts.append(np.tile(at, replicates))
                ranks.append(found.ravel())
            if keys:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(keys))), pa.array(np.concatenate(reps), pa.int32()), pa.array(np.concatenate(ts), pa.int64()), pa.array(np.concatenate(ranks))], ["_k", "rep", "at", "rank"])

    return step


def _drawn_rmse(replicates: int, seed: int):
    """For each group and replicate the root of the mean of n squares, from how many of the n draws fall into each bin; the mean of
    those within a bin is drawn by its own mean and spread."""

    def step(batches):
        for b in batches:
            keys, out = [], []
            for i, (bins, h) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                bins.sort(key=lambda x: x["bin"])
                c, mean, var = (np.array([x[k] for x in bins], float) for k in ("c", "mean", "var"))
                rng = np.random.default_rng([seed, h & (1 << 64) - 1, 1])
                n = int(c.sum())
                times = rng.multinomial(n, c / n, replicates)
                total = times @ mean + np.sqrt(times @ var) * rng.standard_normal(replicates)
                keys.append(np.full(replicates, i))
                out.append(np.sqrt(np.maximum(total, 0) / n))
            if keys:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(keys))), pa.array(np.concatenate(out))], ["_k", "rmse"])

    return step


def bootstrap(df: DataFrame, keys: list[str], col: str, residual: Column | None = None, replicates: int = 2_000, seed: int = 1) -> DataFrame:
    """Bootstrap of the median, of the robust width (IQR / 1.349 over the median) and, of `residual`, of the RMSE.

    Rows are never multiplied by replicates. A replicate's quartiles are order statistics of the group whose ranks are drawn by
    their exact law; all ranks of all replicates are looked up by one distributed selection. A replicate's mean square is drawn from the
    squares' bins (SQUARE_BINS a group). Draws depend on the seed and the key alone. Intervals are those of the replicates' percentiles, from 20 values on;
    standard errors from two on; neither for the width if over 0.025 of the replicates have no positive median. n counts the finite values of `col`, n_rmse those of the residual."""
    r = (F.lit(None) if residual is None else residual).cast("double")
    rows = qs.keyed(df, keys, [F.col(col), r * r])
    by = written(qs.sizes(rows), "bootstrap-sizes")
    kind = by.schema["_k"].dataType.simpleString()
    drawn = written(by.filter("_q = 0").select("_k", "n", F.xxhash64("_k").alias("h")).mapInArrow(_drawn_ranks(replicates, seed), f"_k {kind}, rep int, at long, rank long"), "bootstrap-ranks")
    ends_of = by.filter("_q = 0").select("_k", "_q", "n", "lo", "hi")
    values = qs.selected(rows.filter("_q = 0"), drawn.select("_k", "rank").distinct().join(ends_of, "_k").select("_k", "_q", "lo", "hi", "n", F.col("rank").alias("_t"), "rank"))
    met = drawn.join(values.select("_k", F.col("_t").alias("rank"), "value"), ["_k", "rank"]).join(ends_of.select("_k", "n"), "_k")
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    end = lambda p, f, name: F.max(F.when(F.col("at") == f(place(p)), F.col("value"))).alias(name)
    reps = met.groupBy("_k", "rep", "n").agg(*[end(p, f, f"{name}{p}") for p in (0.25, 0.5, 0.75) for f, name in ((F.floor, "f"), (F.ceil, "c"))])
    at = lambda p: F.col(f"`f{p}`") + (F.col(f"`c{p}`") - F.col(f"`f{p}`")) * (place(p) - F.floor(place(p)))
    reps = reps.select("_k", at(0.5).alias("median"), F.when(at(0.5) > 0, (at(0.75) - at(0.25)) / ROBUST / at(0.5)).alias("width"))
    square = rows.filter("_q = 1").join(by.filter("_q = 1").select("_k", "lo", "hi"), "_k")
    place_of = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SQUARE_BINS), F.lit(SQUARE_BINS - 1))).otherwise(0)
    binned = square.groupBy("_k", place_of.alias("bin")).agg(F.count("*").alias("c"), F.avg("_v").alias("mean"), F.var_pop("_v").alias("var")).groupBy("_k").agg(F.collect_list(F.struct("bin", "c", "mean", "var")).alias("bins"))
    rmse = binned.select("_k", "bins", F.xxhash64("_k").alias("h")).mapInArrow(_drawn_rmse(replicates, seed), f"_k {kind}, rmse double")
    ends = lambda c, k: (F.percentile(c, [0.025, 0.975]).alias(f"{k}qs"), F.stddev_samp(c).alias(f"{k}sd"))  # noqa: E731  of `replicates` values
    found = reps.groupBy("_k").agg(*ends("median", ""), *ends("width", "width_"), (F.count("width") >= 0.975 * F.count("median")).alias("_positive"))
    counts = keyed_counts(df, keys, col, r)
    out = counts.join(found, "_k", "left").join(rmse.groupBy("_k").agg(*ends("rmse", "rmse_")), "_k", "left")
    out = out.withColumns({c: F.when(F.col("_positive"), F.col(c)) for c in ("width_qs", "width_sd")})
    gate = lambda n, least, c: F.when(F.col(n) >= least, c)
    columns = [x for k, n in (("", "n"), ("width_", "n"), ("rmse_", "n_rmse")) for x in (gate(n, 2, F.col(f"{k}sd")).alias(f"{k}se"), *(gate(n, 20, F.get(f"{k}qs", F.lit(i))).alias(f"{k}{e}") for i, e in enumerate(("lo", "hi"))))]
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], "n", "n_rmse", *columns)


def keyed_counts(df: DataFrame, keys: list[str], col: str, residual: Column) -> DataFrame:
    """Finite values of the column and of the residual for every key, those without any included."""
    k = F.struct(*[F.col(x) for x in keys]) if keys else F.struct(F.lit(0).alias("_"))
    finite = lambda c: F.count_if(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.groupBy(k.alias("_k")).agg(finite(F.col(col).cast("double")).alias("n"), finite(residual).alias("n_rmse"))


@lru_cache(None)
def median_ranks() -> tuple[int, ...]:
    """For each number of values to RANKED, by exact binomial sums: the largest j with P(Bin(n, 1/2) <= j - 1) <= 1/40."""
    out = []
    for n in range(RANKED + 1):
        j, below, term = 0, 0, 1  # term: n over j
        while 40 * (below + term) <= 2**n:
            below, j = below + term, j + 1
            term = term * (n - j + 1) // j
        out.append(max(1, j))
    return tuple(out)


def median_order_ci(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Order statistics about the median: the rank j is the largest whose j - 1 has a chance of 0.025 at most under
    Bin(n, 1/2); looked up to RANKED values, its normal limit beyond. From six values on. Ranks are found by selection."""
    rows = qs.keyed(df, keys, [F.col(col)])
    by = written(qs.sizes(rows).filter("n >= 6"), "median-sizes")
    known = F.array(*[F.lit(j) for j in median_ranks()])
    j = F.when(F.col("n") <= RANKED, F.get(known, F.col("n").cast("int"))).otherwise(F.floor((F.col("n") + 1 - Z * F.sqrt("n")) / 2)).cast("long")
    ends = F.array(F.struct(F.lit(0).alias("_t"), (j - 1).alias("rank")), F.struct(F.lit(1).alias("_t"), (F.col("n") - j).alias("rank")))
    found = qs.selected(rows, by.select("_k", "_q", "lo", "hi", "n", F.inline(ends)))
    side = lambda t, name: F.max(F.when(F.col("_t") == t, F.col("value"))).alias(name)
    out = found.groupBy("_k").agg(side(0, "lo"), side(1, "hi")).join(by.select("_k", "n"), "_k")
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], "n", "lo", "hi")


def robust_width(df: DataFrame, keys: list[str], col: str, least: int = 300, error: bool = False) -> DataFrame:
    """IQR / 1.349 over a positive median, from LEAST_ROBUST values on, and the share beyond three robust deviations in
    groups of `least` and more. With `error` also the width's error and interval, see `bootstrap`."""
    m = with_quantiles(df.groupBy(*keys).agg(F.count("*").alias("n")), df, keys, {"q": (col, [0.25, 0.5, 0.75])})
    m = m.select(*keys, "n", F.get("q", F.lit(1)).alias("median"), ((F.get("q", F.lit(2)) - F.get("q", F.lit(0))) / ROBUST).alias("sigma"))
    tails = df.join(m, keys).groupBy(*keys).agg(F.count_if(F.abs(F.col(col) - F.col("median")) > 3 * F.col("sigma")).alias("far"))
    out = m.join(tails, keys).withColumns({
        "width": F.when((F.col("n") >= LEAST_ROBUST) & (F.col("median") > 0), F.col("sigma") / F.col("median")),
        "tail": F.when((F.col("n") >= least) & (F.col("sigma") > 0), F.col("far") / F.col("n")),
    })
    return out if not error else out.join(bootstrap(df, keys, col).select(*keys, "width_se", "width_lo", "width_hi"), keys, "left")


def circular(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Mean direction, resultant, circular deviation and Rayleigh's p of an angle."""
    by = df.groupBy(*keys).agg(F.count(col).alias("n"), F.sum(F.cos(col)).alias("c"), F.sum(F.sin(col)).alias("s"))
    r = F.least(F.lit(1.0), F.try_divide(F.hypot("c", "s"), F.col("n")))
    by = by.withColumns({"mean": F.when((F.col("c") != 0) | (F.col("s") != 0), F.atan2("s", "c")), "r": r})
    sd = F.when(F.col("r") > 0, F.sqrt(F.greatest(F.lit(0.0), -2 * F.ln("r"))))
    return by.withColumns({"sd": sd, "rayleigh_p": F.when(F.col("n") >= 2, F.exp(-F.col("n") * F.col("r") ** 2))})


def clip_range(df: DataFrame, keys: list[str], col: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    m = qs.quantiles(df, keys, {"q": (F.col(col), [low, high])})
    m = m.select(*keys, F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    out = df.join(m, keys) if keys else df.crossJoin(F.broadcast(m))  # one row
    return out.groupBy(*keys, "lo", "hi").agg(F.count_if(F.col(col) < F.col("lo")).alias("below"), F.count_if(F.col(col) > F.col("hi")).alias("above"), F.count("*").alias("n"))


def histogram(df: DataFrame, keys: list[str], col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts and densities on shared edges; the last bin is closed; outside rows count in -1 (below) and `bins` (above).
    The density is that of the rows inside: its area is one, and the two outer bins have none."""
    c = F.col(col)
    at = F.when(c < lo, -1).when(c > hi, bins).otherwise(F.least(F.floor((c - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).cast("int")
    h = df.filter(c.isNotNull() & ~F.isnan(c.cast("double"))).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    inside = F.when(F.col("bin").between(0, bins - 1), F.col("n"))
    return h.withColumn("density", inside / (F.sum(inside).over(Window.partitionBy(*keys)) * ((hi - lo) / bins)))


def band(df: DataFrame, keys: list[str], reco: str, truth: str, lo: float, hi: float, least: int = 10) -> DataFrame:
    """Response and resolution of a range of true values."""
    ratio = F.col(reco) / F.col(truth)
    by = df.filter(F.col(truth).between(lo, hi)).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(ratio).alias("response"), F.stddev_samp(ratio).alias("s"))
    return by.withColumn("resolution", F.when(F.col("n") >= least, F.try_divide("s", "response")))


def kde(df: DataFrame, keys: list[str], col: str, lo: float, hi: float, points: int = 160) -> DataFrame:
    """Gaussian kernel density at `points` places from lo to hi, with the bandwidth h = 0.9 min(s, IQR / 1.349) n**-0.2.

    Rows are binned linearly on nodes of at most h / 4 apart (256 to 8,192 of them, from lo - 4 h to hi + 4 h), so a group is as
    many rows before it meets the points; the kernel ends at 4 h. No row for groups under LEAST_CURVE values, without a
    spread, or whose bandwidth is under two nodes. What lies outside stays missing from the area."""
    v = F.col("_v")
    rows = df.select(*keys, F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & (F.abs("_v") < float("inf")))
    m = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.stddev_samp("_v").alias("_s"))
    m = with_quantiles(m, rows, keys, {"_iqr": ("_v", [0.25, 0.75])})
    iqr = (F.get("_iqr", F.lit(1)) - F.get("_iqr", F.lit(0))) / ROBUST
    m = m.withColumn("h", 0.9 * F.when(iqr > 0, F.least("_s", iqr)).otherwise(F.col("_s")) * F.pow("total", F.lit(-0.2)))
    m = m.filter((F.col("total") >= LEAST_CURVE) & (F.col("h") > 0)).withColumn("_g0", lo - 4 * F.col("h"))
    m = m.withColumn("_m", F.least(F.lit(8192), F.greatest(F.lit(256), F.ceil((hi - lo + 8 * F.col("h")) / (F.col("h") / 4)) + 1)))
    m = m.withColumn("_d", (hi - lo + 8 * F.col("h")) / (F.col("_m") - 1)).filter("_d <= h / 2").select(*keys, "total", "h", "_g0", "_m", "_d")
    t = (v - F.col("_g0")) / F.col("_d")
    placed = rows.join(m, keys).withColumn("_t", t).filter("_t >= 0 AND _t <= _m - 1")
    placed = placed.withColumn("_i", F.least(F.floor("_t"), F.col("_m") - 2)).withColumn("_f", F.col("_t") - F.col("_i"))
    ends = F.array(F.struct(F.col("_i").alias("node"), (1 - F.col("_f")).alias("w")), F.struct((F.col("_i") + 1).alias("node"), F.col("_f").alias("w")))
    nodes = placed.select(*keys, F.inline(ends)).groupBy(*keys, "node").agg(F.sum("w").alias("w"))
    grid = F.array(*[F.struct(F.lit(i).alias("point"), F.lit(lo + (hi - lo) * i / (points - 1)).alias("at")) for i in range(points)])
    met = nodes.join(m, keys).select(*keys, "node", "w", "total", "h", "_d", "_m", "_g0", F.inline(grid))
    place = (F.col("at") - F.col("_g0")) / F.col("_d")
    met = met.withColumn("_k", F.least(F.floor(place), F.col("_m") - 2)).withColumn("_a", place - F.col("_k"))
    steps = F.ceil(4 * F.col("h") / F.col("_d"))
    kernel = lambda j: F.when(F.abs(j) <= steps, F.exp(-0.5 * (j * F.col("_d") / F.col("h")) ** 2)).otherwise(0.0)
    value = F.col("w") * ((1 - F.col("_a")) * kernel(F.col("_k") - F.col("node")) + F.col("_a") * kernel(F.col("_k") + 1 - F.col("node")))
    return met.groupBy(*keys, "point", "at").agg((F.sum(value) / (F.first("h") * F.first("total") * math.sqrt(2 * math.pi))).alias("density"))
