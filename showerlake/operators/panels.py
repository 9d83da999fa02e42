"""Panels over the event and shower tables: summaries, response, resolution, correlations, quality, pickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import estimates as es
from ..functions.quantiles import with_quantiles
from .events import NEGATIVE_DEPTH, profiles, splat  # noqa: F401
from .filters import N_GROUPS, d_slice, finite, group_key, own_shower  # noqa: F401

FRACTION = 0.01


def wrap(x: Column) -> Column:
    return F.atan2(F.sin(x), F.cos(x))


def summary(events: DataFrame) -> DataFrame:
    by = events.agg(
        F.count("*").alias("n"), F.sum("n_hits").alias("n_hits"), F.count_if(F.col("d").isNull()).alias("without_d"), F.sum("e_dep").alias("e_dep"), F.avg("d").alias("mean_d"),
        F.stddev_samp("d").alias("sd_d"), F.avg("e1").alias("mean_e1"), F.avg("e2").alias("mean_e2"), F.avg("cax").alias("mean_cax"), F.avg("cby").alias("mean_cby"),
    )
    return with_quantiles(by, events, [], {"median_d": ("d", 0.5)})


def coherence(showers: DataFrame) -> DataFrame:
    return showers.groupBy("b").agg(F.count("*").alias("n"), F.hypot(F.avg(F.cos("phi")), F.avg(F.sin("phi"))).alias("r"), F.avg("theta").alias("theta"))


def pointing(showers: DataFrame) -> DataFrame:
    """Azimuth of the direction against that of the translated centroid, and the implied depth."""
    off = wrap(F.col("phi") - F.atan2("cyt", "cxt"))
    by = showers.groupBy("b").agg(F.avg(off).alias("mean"), F.stddev_samp(off).alias("sd"))
    return with_quantiles(by, showers, ["b"], {"depth": (F.hypot("cxt", "cyt") / F.tan("theta"), 0.5)})


def trajectories(showers: DataFrame, n: int) -> DataFrame:
    first = showers.select("event_number").distinct().orderBy("event_number").limit(n)
    return showers.join(F.broadcast(first), "event_number", "left_semi")


def window_axis(showers: DataFrame, t0: float, t1: float, stations: int = 9, depth: float = 150.0) -> DataFrame:
    """Mean line and spread, at evenly spaced depths, of the showers that enter between t0 and t1."""
    slope = F.tan("theta") * F.cos("phi")
    s = showers.filter(F.col("p0x").between(t0, t1)).withColumn("slope", slope).groupBy("b").agg(
        F.count("*").alias("n"), F.avg("p0x").alias("entry"), F.var_samp("p0x").alias("v"), F.avg("slope").alias("slope"), F.var_samp("slope").alias("vs"), F.covar_samp("p0x", "slope").alias("cov"),
        F.exp(-F.count("*") * (F.avg(F.cos("phi")) ** 2 + F.avg(F.sin("phi")) ** 2)).alias("rayleigh_p"),
    )
    at = s.withColumn("station", F.explode(F.sequence(F.lit(0), F.lit(stations - 1)))).withColumn("w", F.col("station") * (depth / (stations - 1)))
    return at.withColumns({"centre": F.col("entry") + F.col("slope") * F.col("w"), "spread": F.sqrt(F.greatest(F.lit(0.0), F.col("v") + 2 * F.col("w") * F.col("cov") + F.col("w") ** 2 * F.col("vs")))})


def ensemble_axes(showers: DataFrame) -> DataFrame:
    slope = F.tan("theta") * F.cos("phi")
    by = showers.groupBy("b").agg(F.count("*").alias("n"), F.avg(slope).alias("slope"), F.stddev_samp(slope).alias("sd"))
    lo, hi = es.t_interval(F.col("slope"), F.col("sd"), F.col("n"))
    return by.withColumns({"lo": lo, "hi": hi})


def energy_series(showers: DataFrame) -> DataFrame:
    """Truth, model and calibrated deposit of each shower, as rows."""
    rows = F.array(*[F.struct(F.lit(n).alias("series"), c.alias("value")) for n, c in (("truth", F.col("p")), ("model", F.col("energy_pred")), ("deposit", F.col("e_own") / FRACTION))])
    return showers.select("event_number", "b", "d", "p", "bin", "theta", F.inline(rows))


def energy_by_d(showers: DataFrame) -> DataFrame:
    return es.gauss(energy_series(showers).withColumn("slice", d_slice(F.col("d"))), ["slice", "series"], "value")


def energy_by_p(showers: DataFrame) -> DataFrame:
    return es.gauss(energy_series(showers), ["bin", "series"], "value")


def benchmarks(events: DataFrame) -> DataFrame:
    return events.agg(F.avg("e1").alias("marker_a"), F.avg("e2").alias("marker_b"), F.lit(0.05).alias("width"))


def sampling(showers: DataFrame) -> DataFrame:
    """Sampling fraction of each shower, and the ratio of sums with its interval."""
    return es.ratio_ci(showers, ["b"], F.col("e_own"), F.col("p"))


def sampling_by_bin(showers: DataFrame) -> DataFrame:
    f = es.gauss(showers.withColumn("f", F.col("e_own") / F.col("p")), ["b", "bin"], "f").select("b", "bin", "n", "mu", "s", "mu_lo", "mu_hi")
    return f.join(es.ratio_ci(showers, ["b", "bin"], F.col("e_own"), F.col("p")).select("b", "bin", "ratio"), ["b", "bin"]).withColumn("scale", F.try_divide(F.lit(1.0), F.col("ratio")))


def resolution(showers: DataFrame) -> DataFrame:
    """Width over mean of the calibrated deposit in each momentum bin, with the whiskers of both."""
    s = showers.withColumn("ratio", F.col("e_own") / FRACTION / F.col("p"))
    by = s.groupBy("b", "bin").agg(F.count("*").alias("n"), F.avg("ratio").alias("mu"), F.stddev_samp("ratio").alias("s"), F.stddev_samp("p").alias("sd_p"))
    lo, hi = es.chi2_interval(F.col("s"), F.col("n"))
    return by.withColumns({"res": F.try_divide("s", "mu"), "s_lo": lo, "s_hi": hi})


def resolution_windows(df: DataFrame, keys=("series", "bin")) -> DataFrame:
    """Per window: rows, mean 1/sqrt(p), sample and robust widths of a ratio and its tail."""
    r = F.col("value") / F.col("p")
    by = df.withColumn("r", r).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(1 / F.sqrt("p")).alias("x"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("s"))
    by = with_quantiles(by, df, keys, {"median": (r, 0.5), "off": (F.abs(r - 1), 0.5), "q": (r, [0.25, 0.75])})
    return by.withColumns({"kappa": F.try_divide("s", "mu"), "robust": F.when((F.col("n") >= es.LEAST_ROBUST) & (F.col("median") > 0), (F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / (es.ROBUST * F.col("median")))}).drop("q")


def pooled_scale(windows: DataFrame, least: int = 8) -> DataFrame:
    return windows.filter((F.col("n") >= least) & F.col("kappa").isNotNull()).groupBy("series").agg(F.median(F.sqrt("n") * F.col("kappa")).alias("scale"))


def anchors(windows: DataFrame, nominal=(2.5, 5.5, 10.5), least: int = 15) -> DataFrame:
    """For each nominal energy the nearest window, in log energy, that can be fitted."""
    w = windows.filter(F.col("n") >= least).withColumn("centre", F.col("bin") + 0.5)
    rows = F.array(*[F.struct(F.lit(i).alias("anchor"), F.lit(e).alias("nominal")) for i, e in enumerate(nominal)])
    each = w.select("series", "bin", "centre", F.inline(rows))
    first = Window.partitionBy("series", "anchor").orderBy(F.round(F.abs(F.log(F.col("centre") / F.col("nominal"))), 9), "bin")
    return each.withColumn("place", F.row_number().over(first)).filter("place = 1").select("series", "anchor", "bin")


def median_calibration(showers: DataFrame) -> DataFrame:
    some = showers.filter("e_own > 0")
    return with_quantiles(some.groupBy("b").agg(F.count("*").alias("n")), some, ["b"], {"m": (F.col("e_own") / F.col("p"), 0.5)}).select("b", (1 / F.col("m")).alias("c"))


def dominant_species(events: DataFrame, share: float = 0.95) -> DataFrame:
    by = events.groupBy("primary_type").agg(F.count("*").alias("n"))
    by = by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "primary_type").limit(1)
    return by.withColumn("dominant", (F.col("share") >= share).cast("int"))


def describe_hits(hits: DataFrame) -> DataFrame:
    """Rows of each quantity: count, moments, exact quartiles and energy-weighted mean."""
    rows = F.array(*[F.struct(F.lit(n).alias("quantity"), c.alias("c")) for n, c in (("x", F.col("xl")), ("y", F.col("yl")), ("z", F.col("zl")), ("rho", F.hypot("xl", "yl")), ("e", F.col("energy")))])
    each = hits.select("energy", F.inline(rows))
    by = each.groupBy("quantity").agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.stddev_samp("c").alias("s1"), F.stddev_pop("c").alias("s0"), F.min("c").alias("lo"), F.max("c").alias("hi"), (F.sum(F.col("energy") * F.col("c")) / F.sum("energy")).alias("weighted"))
    by = with_quantiles(by, each, ["quantity"], {"q": ("c", [0.25, 0.5, 0.75])})
    return by.withColumns({f"q{i}": F.get("q", F.lit(i - 1)) for i in (1, 2, 3)})


def weighted_quartiles(hits: DataFrame, c: str = "xl") -> DataFrame:
    """Energy-weighted quartiles to one bin of 1 mm, from the cumulated histogram by linear interpolation."""
    by = hits.groupBy(F.floor(c).alias("bin")).agg(F.sum("energy").alias("e"))
    w = Window.orderBy("bin")
    s = by.withColumns({"upto": F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("e").over(Window.partitionBy())})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.struct(F.col("bin").alias("bin"), (F.col("bin") + (q * F.col("total") - F.col("upto") + F.col("e")) / F.col("e")).alias("at"))))["at"]
    return s.agg(*[at(q).alias(f"q{i}") for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))])


def selection_counts(showers: DataFrame) -> DataFrame:
    return showers.agg(F.countDistinct("event_number").alias("events"), F.count("*").alias("showers"), F.sum("n_own").alias("hits"), F.countDistinct(F.when(F.col("b") == 0, F.col("event_number"))).alias("with_a"))


def affected(hits: DataFrame) -> DataFrame:
    neg = F.col("zl") < NEGATIVE_DEPTH
    by = hits.groupBy("event_number", own_shower(F.col("origin")).alias("b")).agg((F.count_if(neg) / F.count("*")).alias("f")).filter("f > 0")
    return with_quantiles(by.agg(F.count("*").alias("n"), F.avg("f").alias("mean"), F.stddev_samp("f").alias("sd")), by, [], {"median": ("f", 0.5)})


def hit_uvw(hits: DataFrame, size: float = 20.0) -> DataFrame:
    """Histograms of u, v and w by momentum bin from one pass: a row for each axis of a deposit, summed before the shuffle."""
    h = splat(hits, 2, 1)
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), F.floor(c / size).alias("bin")) for a, c in (("u", F.col("xl") + F.col("ox")), ("v", F.col("yl") + F.col("oy")), ("w", F.col("zl")))])
    return h.select(F.floor("p").alias("mb"), F.inline(rows)).groupBy("mb", "axis", "bin").agg(F.count("*").alias("n"))


def hit_energy(hits: DataFrame) -> DataFrame:
    return hits.groupBy(F.floor("p").alias("mb"), F.floor(F.log10("energy") * 100).alias("bin")).agg(F.count("*").alias("n"))


def shower_hist(showers: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """By momentum bin, weighted by showers and by hits; -1 below, `bins` above."""
    c = F.col(column)
    at = F.when(c < lo, -1).when(c >= hi, bins).otherwise(F.floor((c - lo) / ((hi - lo) / bins)))
    return showers.groupBy(F.col("bin").alias("mb"), at.cast("int").alias("at")).agg(F.count("*").alias("n"), F.sum("n_own").alias("hits"))


def shower_hists(showers: DataFrame, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """`shower_hist` of each quantity (lo, hi, bins), in one pass: its place on each axis is a row before the partial sums."""
    at = lambda c, lo, hi, n: F.when(c < lo, -1).when(c >= hi, n).otherwise(F.floor((c - lo) / ((hi - lo) / n))).cast("int")
    rows = F.array(*[F.struct(F.lit(q).alias("quantity"), at(F.col(q), *axis).alias("at")) for q, axis in axes.items()])
    return showers.select(F.col("bin").alias("mb"), "n_own", F.inline(rows)).groupBy("quantity", "mb", "at").agg(F.count("*").alias("n"), F.sum("n_own").alias("hits"))


def weighted_percentile(showers: DataFrame) -> DataFrame:
    return with_quantiles(showers.select("b").distinct(), showers, ["b"], {"median_p": ("p", 0.5), "p90_theta": ("theta", 0.9)}, F.col("n_own"))


MOMENT_COLUMNS = {"x": "xl", "y": "yl", "z": "zl", "e": "loge", "p": "p", "t": "theta", "c": "cphi", "s": "sphi"}
SHIFT = {"z": 70.0, "p": 8.0, "e": -1.5}


def hit_moments(hits: DataFrame) -> DataFrame:
    """Per jackknife group: rows, sums and sums of products of eight (shifted) variables."""
    h = hits.withColumns({"loge": F.log10("energy"), "cphi": F.cos("phi"), "sphi": F.sin("phi")})
    v = {n: F.col(c) - SHIFT.get(n, 0.0) for n, c in MOMENT_COLUMNS.items()}
    return _moments(h, v)


def _moments(df: DataFrame, v: dict[str, Column]) -> DataFrame:
    names = list(v)
    sums = [F.sum(v[n]).alias(f"s_{n}") for n in names] + [F.sum(v[a] * v[b]).alias(f"s_{a}{b}") for i, a in enumerate(names) for b in names[i:]]
    return df.groupBy(group_key(F.col("event_number")).alias("g")).agg(F.count("*").alias("n"), *sums)


def event_moments(showers: DataFrame, weighted_by_hits: bool = False) -> DataFrame:
    s = showers.withColumns({"cphi": F.cos("phi"), "sphi": F.sin("phi")})
    if weighted_by_hits:
        w = F.col("n_own")
        return s.groupBy(group_key(F.col("event_number")).alias("g")).agg(F.sum(w).alias("n"), *[F.sum(w * F.col(c)).alias(f"s_{n}") for n, c in (("p", "p"), ("t", "theta"), ("c", "cphi"), ("s", "sphi"))], F.sum(w * F.col("p") * F.col("theta")).alias("s_pt"))
    return _moments(s, {"p": F.col("p") - 8.0, "t": F.col("theta"), "c": F.col("cphi"), "s": F.col("sphi")})


def _r(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    return F.try_divide(n * ab - a * b, F.sqrt(F.greatest(F.lit(0.0), n * aa - a * a)) * F.sqrt(F.greatest(F.lit(0.0), n * bb - b * b)))


def corr_matrix(sums: DataFrame, names="xyzept") -> DataFrame:
    """Pearson's r of each pair from the groups' sums, with the leave-one-group-out error of Fisher's z."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = F.array(*[F.struct(F.lit(a + b).alias("pair"), *[F.col(c).cast("double").alias(k) for k, c in (("a", f"s_{a}"), ("b", f"s_{b}"), ("aa", f"s_{a}{a}"), ("bb", f"s_{b}{b}"), ("ab", f"s_{a}{b}"))]) for a, b in pairs])
    long = sums.select("g", F.col("n").cast("double").alias("n"), F.inline(rows))
    cols = ("n", "a", "b", "aa", "bb", "ab")
    w = Window.partitionBy("pair")
    long = long.withColumns({f"t_{c}": F.sum(c).over(w) for c in cols})
    full = _r(*[F.col(f"t_{c}") for c in cols])
    left = _r(*[F.col(f"t_{c}") - F.col(c) for c in cols])
    z = long.select("pair", full.alias("r"), F.atanh(left).alias("z"), F.col("t_n").alias("n"))
    by = z.groupBy("pair").agg(F.first("r").alias("r"), F.first("n").alias("n"), F.count("*").alias("groups"), F.var_pop("z").alias("v"))
    return by.withColumn("se", F.sqrt((F.col("groups") - 1) * F.col("v")))


def mardia(sums: DataFrame, linear: str = "p") -> DataFrame:
    """Linear-circular correlation from the three Pearson ones of a variable with the cosine and sine of an angle."""
    t = sums.agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "s_p", "s_c", "s_s", f"s_{linear}{linear}", "s_cc", "s_ss", "s_pc", "s_ps", "s_cs")])
    c = F.col
    xc = _r(c("n"), c("s_p"), c("s_c"), c("s_pp"), c("s_cc"), c("s_pc"))
    xs = _r(c("n"), c("s_p"), c("s_s"), c("s_pp"), c("s_ss"), c("s_ps"))
    cs = _r(c("n"), c("s_c"), c("s_s"), c("s_cc"), c("s_ss"), c("s_cs"))
    return t.select(xc.alias("xc"), xs.alias("xs"), cs.alias("cs")).withColumn("r", F.sqrt((F.col("xc") ** 2 + F.col("xs") ** 2 - 2 * F.col("xc") * F.col("xs") * F.col("cs")) / (1 - F.col("cs") ** 2)))


LINEAR = ("width", "height", "depth", "mean_r", "max_r", "weighted_r", "avg_theta")


def feature_table(features: DataFrame, events: DataFrame) -> DataFrame:
    """Features with momentum, bin and label; showers of one hit are left out."""
    return features.filter("n > 1").join(events.select("event_number", "p", "p_bin"), "event_number").withColumn("label", (F.col("p") >= 2).cast("int"))


def long_features(ft: DataFrame, names=LINEAR) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return ft.select("event_number", "label", "p", F.inline(rows))


def feature_describe(ft: DataFrame) -> DataFrame:
    each = long_features(ft)
    by = each.groupBy("label", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("s1"), F.stddev_pop("value").alias("s0"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value") <= 1e-6).alias("floored"))
    by = with_quantiles(by, each, ["label", "feature"], {"qs": ("value", [0.25, 0.5, 0.75])})
    by = by.withColumns({name: F.get("qs", F.lit(i)) for i, name in enumerate(("q25", "median", "q75"))}).drop("qs")
    lo, hi = es.t_interval(F.col("mean"), F.col("s1"), F.col("n"))
    sd_lo, sd_hi = es.chi2_interval(F.col("s1"), F.col("n"))
    se = F.try_divide(F.col("s1"), F.sqrt(2.0 * (F.col("n") - 1)))
    return by.withColumns({"mean_lo": lo, "mean_hi": hi, "sd_lo": sd_lo, "sd_hi": sd_hi, "sd_se": se, "s_unbiased": F.col("s1") / es.c4(F.col("n"))})


def feature_corr(ft: DataFrame, names=LINEAR) -> DataFrame:
    """Pearson's r of each pair of features in each class, without rows that either feature floors."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = F.array(*[F.struct(F.lit(f"{a}:{b}").alias("pair"), F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    by = ft.select("label", F.inline(rows)).filter("u > 1e-6 AND v > 1e-6").groupBy("label", "pair").agg(es.correlation(F.col("u"), F.col("v")).alias("r"), F.count("*").alias("n"))
    lo, hi = es.fisher_ci(F.least(F.lit(1 - 1e-12), F.col("r")), F.col("n"))
    return by.withColumns({"lo": lo, "hi": hi})


def circ_corr(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of two angles from the resultants of their difference and sum about their means."""
    m = df.agg(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))).alias("ma"), F.atan2(F.avg(F.sin(b)), F.avg(F.cos(b))).alias("mb"))
    x, y = F.sin(F.col(a) - F.col("ma")), F.sin(F.col(b) - F.col("mb"))
    return df.crossJoin(F.broadcast(m)).agg((F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("r"), F.count("*").alias("n"))


def rice_bins(n: Column) -> Column:
    return F.ceil(2 * F.pow(n, F.lit(1 / 3)))


def feature_hist(ft: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts of a feature on edges shared by the classes."""
    ends = ft.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))
    return ft.crossJoin(F.broadcast(ends)).groupBy("label", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def value_step(df: DataFrame, column: str) -> DataFrame:
    """The quantum of a quantised value: the smallest gap between distinct values."""
    v = df.select(F.round(column, 6).alias("v")).distinct()
    return v.withColumn("gap", F.col("v") - F.lag("v").over(Window.orderBy("v"))).agg(F.min("gap").alias("step"), F.count("*").alias("n"))


def hist2d(df: DataFrame, x: tuple, y: tuple) -> DataFrame:
    """Counts on two axes (column, start, width). A value on an edge is in the upper bin, however its sum was rounded: places
    are taken to nine digits of a bin."""
    at = lambda c, lo, w: F.floor(F.round((F.col(c) - lo) / w, 9)).cast("int")
    return df.groupBy(at(*x).alias("bx"), at(*y).alias("by")).agg(F.count("*").alias("n"))


def seg_quality(events: DataFrame, *keys: str) -> DataFrame:
    """Segmentation quality from the events' sums."""
    s = events.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_hits", "n_correct", "n_true", "n_pred", "n_tp", "abs_err", "wabs_err", "sq_err", "e_dep")])
    p, r = F.try_divide("n_tp", "n_pred"), F.try_divide("n_tp", "n_true")
    return s.withColumns({"accuracy": F.col("n_correct") / F.col("n_hits"), "precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r), "mae": F.col("abs_err") / F.col("n_hits"), "weighted_mae": F.col("wabs_err") / F.col("e_dep"), "rmse": F.sqrt(F.col("sq_err") / F.col("n_hits"))})


def perf_bins(showers: DataFrame) -> DataFrame:
    err = F.col("energy_pred") - F.col("p")
    by = showers.groupBy("b", "bin").agg(F.count(err).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("bias"), F.count_if(F.col("energy_pred").isNull()).alias("missing"))
    return with_quantiles(by, showers, ["b", "bin"], {"median_rel": (err / F.col("p"), 0.5), "median_abs": (F.abs(err), 0.5)})


def pred_density(showers: DataFrame, hi: float = 20.0, bins: int = 20) -> DataFrame:
    """Counts on shared axes of prediction and truth; bin -1 and `bins` are outside, -2 is missing."""
    at = lambda c: F.when(F.col(c).isNull(), -2).when(F.col(c) < 0, -1).when(F.col(c) >= hi, bins).otherwise(F.floor(F.col(c) / (hi / bins))).cast("int")
    return showers.groupBy("b", at("energy_pred").alias("pb"), at("p").alias("tb")).agg(F.count("*").alias("n"))


def residual_hist(showers: DataFrame) -> DataFrame:
    """Residuals in Freedman-Diaconis bins over the 1 to 99 % range."""
    r = showers.select(((F.col("energy_pred") - F.col("p")) / F.col("p")).alias("r"))
    q = with_quantiles(r.agg(F.count("*").alias("total")), r, [], {"q": ("r", [0.01, 0.25, 0.75, 0.99])})
    q = q.select(F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(3)).alias("hi"), (2 * (F.get("q", F.lit(2)) - F.get("q", F.lit(1))) / F.pow("total", F.lit(1 / 3))).alias("w"))
    inside = r.crossJoin(F.broadcast(q)).filter("r BETWEEN lo AND hi")
    return inside.groupBy(F.floor((F.col("r") - F.col("lo")) / F.col("w") + 1e-9).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def primaries(events: DataFrame) -> DataFrame:
    by = events.groupBy("p_bin").agg(F.count("*").alias("n"), F.count_if(F.col("n_primary") == 0).alias("k"))
    lo, hi = es.wilson(F.col("k"), F.col("n"))
    return by.withColumns({"lo": lo, "hi": hi})


def primary_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.least("n_primary", F.lit(10)).alias("bucket")).agg(F.count("*").alias("n"))


def in_pool() -> Column:
    return F.col("d").isNotNull() & (F.col("n_hits") >= 3)


def candidates(events: DataFrame, p=(5, 10)) -> DataFrame:
    a, b = F.col("e1").between(*p), F.col("e2").between(*p)
    return events.agg(F.count("*").alias("selected"), F.count_if(F.col("d").isNull()).alias("unplaceable"), F.count_if(in_pool()).alias("pool"), F.sum(a.cast("int") + b.cast("int")).alias("matching"), F.count_if(a & b).alias("both"))


def membership(events: DataFrame, event: int) -> DataFrame:
    """Rank of an event in the pool, the pool's size and the events on either side, by conditional aggregates."""
    n = F.col("event_number")
    return events.filter(in_pool()).agg(F.count_if(n <= event).alias("rank"), F.count("*").alias("size"), F.max(F.when(n < event, n)).alias("before"), F.min(F.when(n > event, n)).alias("after"))


def pick_tilted(events: DataFrame, most: int = 20, seed: int = 0) -> DataFrame:
    """Of the placeable events with more hits than their mean, the `most` with the largest polar angle of either shower (if
    none has more, those with most hits), and which of them a seeded order draws."""
    placed = events.filter("d IS NOT NULL").withColumn("theta", F.greatest("theta_a", "theta_b"))
    mean = placed.agg(F.avg("n_hits").alias("mean_hits"), F.max("n_hits").alias("max_hits"))
    pool = placed.crossJoin(F.broadcast(mean)).filter("n_hits > mean_hits OR max_hits <= mean_hits")
    rank = F.when(F.col("max_hits") > F.col("mean_hits"), F.round("theta", 9)).otherwise(F.col("n_hits").cast("double"))
    pool = pool.orderBy(rank.desc(), "event_number").limit(most)
    key = F.pmod(F.col("event_number") * 7919 + seed * 104729, F.lit(1000003))
    place = F.row_number().over(Window.orderBy(key, "event_number"))  # of `most` rows
    return pool.withColumn("drawn", (place == 1).cast("int"))


def pick_densest(events: DataFrame, most: int) -> DataFrame:
    return events.orderBy(F.desc_nulls_last("n_hits"), "event_number").limit(most)


def pick_uniform(events: DataFrame, seed: int, draw: int, span: int = 1024) -> DataFrame:
    """The draw-th event, modulo the pool, of a seeded order: by a hash, then by number.

    Hashes are counted in ranges of `span`, then one by one in the range that holds the draw; only the events of a single hash
    are put in order. The driver sees two lists of about a thousand counts, whatever the pool."""
    key = F.pmod(F.col("event_number") * 7919 + seed * 104729, F.lit(1000003))
    pool = events.filter(in_pool()).withColumn("_key", key)
    counts = lambda df, c: sorted((r[0], r[1]) for r in df.groupBy(c.alias("at")).count().collect())
    ranges = counts(pool, F.floor(F.col("_key") / span))
    rest = draw % max(1, sum(n for _, n in ranges))

    def holder(of: list) -> int:
        nonlocal rest
        for at, n in of:
            if rest < n:
                return at
            rest -= n
        return -1  # an empty pool

    within = holder(ranges)
    one = holder(counts(pool.filter(F.floor(F.col("_key") / span) == within), F.col("_key")))
    place = F.row_number().over(Window.orderBy("event_number"))  # of one hash in a million
    return pool.filter(F.col("_key") == one).withColumn("_at", place).filter(F.col("_at") == rest + 1).drop("_key", "_at")


def resolution_inputs(showers: DataFrame) -> DataFrame:
    return energy_series(showers).filter("p > 0").withColumn("ratio", F.col("value") / F.col("p"))


def p_marker(showers: DataFrame) -> DataFrame:
    return showers.groupBy("bin").agg(F.avg("p").alias("mean"), F.stddev_samp("p").alias("sd"), F.min("p").alias("lo"), F.max("p").alias("hi"))
