"""Statistics whose sampling unit is the event: ratios of sums, profiles and circular correlations, with intervals.

Rows of one event are not independent, so an error comes from sums over events (ratios, profiles) or from leaving out
groups of events (correlations). All of it is sums by key, or by key and group of events; windows see those sums alone, at
most N_GROUPS rows a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import estimates as es
from .events import NEGATIVE_DEPTH
from .filters import d_slice, group_key, own_shower

# Least distinct directions and groups of a circular-linear correlation, least groups of a jackknife, least
# directions of an interval of their mean, how near to 1 two variables are collinear, the mean square without spread, the
# share of its energy that a shower keeps at least, and the momentum splits of the negative depth.
LEAST_AZIMUTHS, LEAST_MARDIA_GROUPS, LEAST_GROUPS, LEAST_DIRECTIONS = 8, 5, 4, 25
COLLINEAR, NO_SPREAD, KEPT_FLOOR = 1e-9, 1e-12, 1e-12
LOW_P, HIGH_P = 1.0, 10.0


def _known(c: Column, value: Column) -> Column:
    """`greatest` and `least` skip nulls; this keeps them."""
    return F.when(c.isNotNull(), value)


def ratios(df: DataFrame, keys: list[str], pairs: dict[str, tuple[Column, Column]], *more: Column, upper: float | None = 1.0) -> DataFrame:
    """Sum over sum of each pair (rows are clusters) in one pass: name, name_se, and the t-interval name_lo to name_hi, cut at
    0 and `upper`. None without a denominator; no error or interval of a single cluster. `more` are further aggregates."""
    sums = []
    for name, (a, b) in pairs.items():
        a, b = a.cast("double"), b.cast("double")
        sums += [F.sum(v).alias(f"_{name}_{k}") for k, v in (("u", a), ("v", b), ("uu", a * a), ("uv", a * b), ("vv", b * b))]
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *more)
    c, n = F.col, F.col("n")
    for name in pairs:
        u, v, uu, uv, vv = (c(f"_{name}_{k}") for k in ("u", "v", "uu", "uv", "vv"))
        by = by.withColumn(name, F.try_divide(u, v))
        spread = F.greatest(F.lit(0.0), uu - 2 * c(name) * uv + c(name) ** 2 * vv)
        by = by.withColumn(f"{name}_se", F.try_divide(F.sqrt(spread * F.try_divide(n, n - 1)), F.abs(v)))
        half = es.t975(n - 1) * c(f"{name}_se")
        hi = c(name) + half
        by = by.withColumns({f"{name}_lo": _known(half, F.greatest(F.lit(0.0), c(name) - half)), f"{name}_hi": hi if upper is None else _known(half, F.least(F.lit(upper), hi))})
    return by.drop(*[f"_{name}_{k}" for name in pairs for k in ("u", "v", "uu", "uv", "vv")])


SEG_CARDS = {"accuracy": ("n_correct", "n_hits"), "precision": ("n_tp", "n_pred"), "recall": ("n_tp", "n_true"), "f1": ("2 * n_tp", "n_pred + n_true"), "mae": ("abs_err", "n_hits"), "weighted_mae": ("wabs_err", "e_dep")}


def seg_cards(events: DataFrame) -> DataFrame:
    """Segmentation quality of all events and of each slice of separation: one row a card with value, se, lo and hi.

    Events without a separation count for all of them only. The RMSE has the square roots of its mean square's interval."""
    each = events.withColumn("slice", F.explode(F.array(F.lit("all"), d_slice(F.col("d")).cast("string")))).filter("slice <> '-1'")
    pairs = {name: (F.expr(a), F.expr(b)) for name, (a, b) in SEG_CARDS.items()}
    wide = ratios(each, ["slice"], pairs).join(ratios(each, ["slice"], {"mse": (F.col("sq_err"), F.col("n_hits"))}, upper=None).drop("n"), "slice")
    root = lambda end: _known(F.col(f"mse{end}"), F.sqrt(F.greatest(F.lit(0.0), F.col(f"mse{end}"))))
    wide = wide.withColumns({"rmse": root(""), "rmse_lo": root("_lo"), "rmse_hi": root("_hi"), "rmse_se": F.try_divide(F.col("mse_se"), 2 * root(""))})
    rows = F.array(*[F.struct(F.lit(name).alias("card"), *[F.col(name + end).alias(k) for k, end in (("value", ""), ("se", "_se"), ("lo", "_lo"), ("hi", "_hi"))]) for name in (*SEG_CARDS, "rmse")])
    return wide.select("slice", "n", F.inline(rows))


def negative_depth(hits: DataFrame, low: float = LOW_P, high: float = HIGH_P) -> DataFrame:
    """Hits and energy in front of the entry layer, as shares, of all showers and of those under `low`, over `high` and between.

    A shower belongs to the split of its own momentum; an event is one cluster of each split that it has showers in."""
    neg = F.col("zl") < NEGATIVE_DEPTH
    by = hits.groupBy("event_number", own_shower(F.col("origin")).alias("b")).agg(F.max("p").alias("p"), F.count("*").alias("hits"), F.count_if(neg).alias("hits_neg"), F.sum("energy").alias("e"), F.coalesce(F.sum(F.when(neg, F.col("energy"))), F.lit(0.0)).alias("e_neg"))
    split = F.when(F.col("p") < low, "low").when(F.col("p") > high, "high").otherwise("mid")
    each = by.withColumn("split", F.explode(F.array(F.lit("all"), split)))
    events = each.groupBy("split", "event_number").agg(F.count("*").alias("k"), F.count_if(F.col("hits_neg") > 0).alias("k_any"), *[F.sum(c).alias(c) for c in ("hits", "hits_neg", "e", "e_neg")])
    found = ratios(
        events, ["split"], {"hit_share": (F.col("hits_neg"), F.col("hits")), "energy_share": (F.col("e_neg"), F.col("e"))},
        F.sum("k").alias("showers"), F.sum("k_any").alias("showers_any"), F.count_if(F.col("hits_neg") > 0).alias("events_any"),
    )
    lo, hi = es.wilson(F.col("events_any"), F.col("n"))
    return found.withColumns({"any_lo": lo, "any_hi": hi})


DEPTH, RADIUS, LAYER = 0, 1, 2


def profile_curves(prof: DataFrame, showers: DataFrame, layers: DataFrame | None = None, drop_negative: bool = False) -> DataFrame:
    """By axis (depth, radius and, with `layers`, a shower's own layers) and bin: mean share of a shower's energy with its
    spread and the t-interval of the mean over events; sum over sum of energies with its interval.

    drop_negative takes energy in front of the entry layer out of shares and norms (layers don't tell it apart); showers
    that keep nothing are left out. It is the showers' `lost`, if they have that, or else a sum over their profiles. A bin that a shower doesn't reach counts as zero. An event's showers are one cluster."""
    rows = prof.select("event_number", "b", "axis", "bin", "e", "e_neg")
    s = showers.select("event_number", "b", F.col("e_own").alias("norm"), *[c for c in ("lost",) if c in showers.columns])
    if drop_negative and "lost" in s.columns:
        s = s.withColumn("kept", F.col("norm") - F.col("lost"))
    elif drop_negative:
        lost = rows.filter(F.col("axis") == DEPTH).groupBy("event_number", "b").agg(F.sum("e_neg").alias("lost"))
        sides = lost.groupBy("event_number").agg(*[F.max(F.when(F.col("b") == b, F.col("lost"))).alias(f"lost_{b}") for b in (0, 1)])
        gone = F.coalesce(F.when(F.col("b") == 0, F.col("lost_0")).otherwise(F.col("lost_1")), F.lit(0.0))
        s = s.join(sides, "event_number", "left").withColumn("kept", F.col("norm") - gone)
    if drop_negative:
        s = s.filter(F.col("kept") > KEPT_FLOOR * F.col("norm")).select("event_number", "b", F.col("kept").alias("norm"))
        rows = rows.withColumn("e", F.col("e") - F.col("e_neg"))
    if layers is not None:
        rows = rows.drop("e_neg").unionByName(layers.select("event_number", "b", F.lit(LAYER).alias("axis"), F.col("layer").alias("bin"), "e"))
    # The showers of one event side by side, so that all that follows meets by event alone: hits dealt by event are dealt no more.
    of = lambda b: F.max(F.when(F.col("b") == b, F.col("norm"))).alias(f"norm_{b}")
    s = s.filter("norm > 0").groupBy("event_number").agg(F.count("*").alias("m"), F.sum("norm").alias("den"), of(0), of(1))
    whole = s.agg(
        F.sum("m").cast("double").alias("n"), F.count("*").cast("double").alias("g"), F.sum(F.col("m") * F.col("m")).alias("m2"), F.sum("den").alias("all_den"), F.sum(F.col("den") ** 2).alias("den2"),
    )
    f = F.col("e") / F.col("norm")
    met = rows.join(s, "event_number").withColumn("norm", F.when(F.col("b") == 0, F.col("norm_0")).otherwise(F.col("norm_1"))).filter("norm IS NOT NULL")
    cell = met.groupBy("event_number", "axis", "bin", "m", "den").agg(F.sum("e").alias("num"), F.sum(f).alias("c"), F.sum(f * f).alias("q"))
    c = F.col
    by = cell.groupBy("axis", "bin").agg(
        F.sum("num").alias("sn"), F.sum(c("num") ** 2).alias("snn"), F.sum(c("num") * c("den")).alias("snd"), F.sum("c").alias("sc"), F.sum("q").alias("sq"), F.sum(c("c") ** 2).alias("scc"), F.sum(c("m") * c("c")).alias("smc"),
    ).crossJoin(F.broadcast(whole))  # fmt: skip  one row
    by = by.withColumns({"mean": c("sc") / c("n"), "pooled": F.try_divide("sn", "all_den")})
    spread = lambda x: F.greatest(F.lit(0.0), x)
    more = F.try_divide(c("g"), c("g") - 1)
    half = es.t975(c("g") - 1) * F.sqrt(more * spread(c("scc") - 2 * c("mean") * c("smc") + c("mean") ** 2 * c("m2"))) / c("n")
    p_half = es.t975(c("g") - 1) * F.sqrt(more * spread(c("snn") - 2 * c("pooled") * c("snd") + c("pooled") ** 2 * c("den2"))) / c("all_den")
    sd = F.sqrt(spread(F.try_divide(c("sq") - c("n") * c("mean") ** 2, c("n") - 1)))
    return by.select("axis", "bin", "mean", F.when(c("n") > 1, sd).alias("sd"), (c("mean") - half).alias("lo"), (c("mean") + half).alias("hi"), "pooled", (c("pooled") - p_half).alias("pooled_lo"), (c("pooled") + p_half).alias("pooled_hi"))


def _left_out(sums: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """To sums by keys and group: those over all groups (t_) and over all but the own (l_)."""
    w = Window.partitionBy(*keys)
    out = sums.withColumns({f"t_{c}": F.sum(c).over(w) for c in names})
    return out.withColumns({f"l_{c}": F.col(f"t_{c}") - F.col(c) for c in names})


def mardia_r(xc: Column, xs: Column, cs: Column) -> Column:
    """R of a variable with an angle from its correlations with cosine and sine and theirs. Where these are collinear or one
    has no spread, the size of the correlation with the one that varies."""
    num = F.try_divide(xc * xc + xs * xs - 2 * xc * xs * cs, 1 - cs * cs)
    full = _known(num, F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), num))))
    one = F.coalesce(F.abs(xc), F.abs(xs))
    return F.when(F.coalesce(1 - F.abs(cs) > COLLINEAR, F.lit(False)), full).otherwise(_known(one, F.least(F.lit(1.0), one)))


def _pearson(t: str, a: str, b: str) -> Column:
    n, c = F.col(f"{t}_n"), lambda k: F.col(f"{t}_{k}")
    va, vb = n * c(a + a) - c(a) ** 2, n * c(b + b) - c(b) ** 2
    return F.try_divide(n * c("".join(sorted(a + b))) - c(a) * c(b), F.sqrt(F.greatest(F.lit(0.0), va)) * F.sqrt(F.greatest(F.lit(0.0), vb)))


def circular_linear(rows: DataFrame, keys: list[str], x: Column, angle: Column) -> DataFrame:
    """Mardia's R of a variable with an angle by keys, with the error of leaving out groups of events (from five groups on).

    n, azimuths (distinct directions, at 1e-9), r, se, and null_r2, the mean of R squared without any dependence. Under
    eight directions there is no r. Groups give means and co-moments, and these are put together about the common mean, so
    large values lose no digits. Rows without a value or an angle take no part."""
    d = rows.select(*keys, group_key(F.col("event_number")).alias("g"), x.cast("double").alias("x"), angle.alias("a")).filter("x IS NOT NULL AND a IS NOT NULL")
    d = d.withColumns({"c": F.cos("a"), "s": F.sin("a")})
    pairs = [("x", "x"), ("c", "c"), ("s", "s"), ("c", "x"), ("s", "x"), ("c", "s")]
    by = d.groupBy(*keys, "g").agg(F.count("*").cast("double").alias("n"), *[F.avg(v).alias(f"m_{v}") for v in "xcs"], *[F.covar_pop(a, b).alias(f"v_{a}{b}") for a, b in pairs])
    w = Window.partitionBy(*keys)
    by = by.withColumns({f"d_{v}": F.col(f"m_{v}") - F.sum(F.col("n") * F.col(f"m_{v}")).over(w) / F.sum("n").over(w) for v in "xcs"})
    about = {v: F.col("n") * F.col(f"d_{v}") for v in "xcs"} | {a + b: F.col("n") * (F.col(f"v_{a}{b}") + F.col(f"d_{a}") * F.col(f"d_{b}")) for a, b in pairs}
    sums = _left_out(by.select(*keys, "g", "n", *[v.alias(k) for k, v in about.items()]), keys, ["n", *about])
    r = lambda t: mardia_r(_pearson(t, "c", "x"), _pearson(t, "s", "x"), _pearson(t, "c", "s"))
    found = sums.select(*keys, F.col("t_n").cast("long").alias("n"), r("t").alias("r"), r("l").alias("left")).groupBy(*keys, "n", "r").agg(F.count("left").alias("groups"), F.var_pop("left").alias("v"))
    azimuths = d.select(*keys, F.round("a", 9).alias("a")).distinct().groupBy(*keys).agg(F.count("*").alias("azimuths"))
    gate = F.col("azimuths") >= LEAST_AZIMUTHS
    se = F.when(gate & F.col("r").isNotNull() & (F.col("groups") >= LEAST_MARDIA_GROUPS), F.sqrt((F.col("groups") - 1) * F.col("v")))
    return found.join(azimuths, keys).withColumns({"se": se, "r": F.when(gate, F.col("r")), "null_r2": F.when(F.col("n") >= 4, 2 / (F.col("n") - 1))}).drop("v")


def circular_circular(rows: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Correlation of two angles about their mean directions, from sums of products of their cosines and sines, with the
    interval of leaving out groups of events (from four on) on Fisher's scale. Under four pairs, or without spread: none."""
    d = rows.select(*keys, group_key(F.col("event_number")).alias("g"), F.cos(a).alias("p"), F.sin(a).alias("q"), F.cos(b).alias("u"), F.sin(b).alias("v")).filter("p IS NOT NULL AND u IS NOT NULL")
    products = ["pp", "pq", "qq", "uu", "uv", "vv", "pu", "pv", "qu", "qv"]
    by = d.groupBy(*keys, "g").agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(c) for c in "pquv"], *[F.sum(F.col(x[0]) * F.col(x[1])).alias(x) for x in products])
    sums = _left_out(by, keys, ["n", *"pquv", *products])

    def r(t: str) -> Column:
        c = lambda k: F.col(f"{t}_{k}")
        la, lb = F.hypot(c("p"), c("q")), F.hypot(c("u"), c("v"))  # unit vectors across the mean directions
        ax, ay, bx, by_ = -F.try_divide(c("q"), la), F.try_divide(c("p"), la), -F.try_divide(c("v"), lb), F.try_divide(c("u"), lb)
        saa = ax * ax * c("pp") + 2 * ax * ay * c("pq") + ay * ay * c("qq")
        sbb = bx * bx * c("uu") + 2 * bx * by_ * c("uv") + by_ * by_ * c("vv")
        sab = ax * bx * c("pu") + ax * by_ * c("pv") + ay * bx * c("qu") + ay * by_ * c("qv")
        value = F.try_divide(sab, F.sqrt(saa * sbb))
        return F.when((saa > NO_SPREAD * c("n")) & (sbb > NO_SPREAD * c("n")), _known(value, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))))

    each = sums.select(*keys, F.col("t_n").cast("long").alias("n"), r("t").alias("r"), r("l").alias("left"))
    z = F.when(F.abs("left") < 1, F.atanh("left"))
    found = each.groupBy(*keys, "n", "r").agg(F.count("*").alias("groups"), F.count(z).alias("_k"), F.var_pop(z).alias("_v"))
    found = found.withColumns({"r": F.when(F.col("n") >= 4, F.col("r")), "se_z": F.when(F.col("_k") >= LEAST_GROUPS, F.sqrt((F.col("_k") - 1) * F.col("_v")))})
    half = F.when((F.abs("r") < 1) & (F.col("se_z") > 0), es.t975(F.col("groups") - 1) * F.col("se_z"))
    return found.withColumns({"lo": F.tanh(F.atanh("r") - half), "hi": F.tanh(F.atanh("r") + half)}).drop("_k", "_v")


def mean_direction(df: DataFrame, keys: list[str], angle: Column) -> DataFrame:
    """Mean direction, resultant, circular deviation and Rayleigh's p of an angle, with Fisher's large-sample interval of the
    direction from 25 angles on (se, lo, hi; the second moment is taken about the mean by its own sums)."""
    a = df.select(*keys, angle.alias("_a")).filter("_a IS NOT NULL")
    by = a.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.cos("_a")).alias("c"), F.avg(F.sin("_a")).alias("s"), F.avg(F.cos(2 * F.col("_a"))).alias("c2"), F.avg(F.sin(2 * F.col("_a"))).alias("s2"))
    by = by.withColumns({"mean": F.atan2("s", "c"), "r": F.least(F.lit(1.0), F.hypot("c", "s"))})
    rho2 = F.col("c2") * F.cos(2 * F.col("mean")) + F.col("s2") * F.sin(2 * F.col("mean"))
    se = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(1 - rho2, 2 * F.col("r") ** 2)) / F.col("n"))
    by = by.withColumn("se", F.when((F.col("n") >= LEAST_DIRECTIONS) & (F.col("r") > 0) & (es.Z * se < 1), se))
    half = F.asin(es.Z * F.col("se"))
    sd = F.when(F.col("r") > 0, F.sqrt(F.greatest(F.lit(0.0), -2 * F.ln("r"))))
    return by.withColumns({"sd": sd, "lo": F.col("mean") - half, "hi": F.col("mean") + half, "rayleigh_p": F.when(F.col("n") >= 2, F.exp(-F.col("n") * F.col("r") ** 2))}).drop("c", "s", "c2", "s2")


def residual_cards(showers: DataFrame) -> DataFrame:
    """Of each shower, for all and by slice of separation, and for energy (relative; its RMSE in GeV) and angle (mrad): bias,
    deviation, RMSE and the correlation of prediction and truth, each with its interval."""
    e, t = F.col("energy_pred"), F.col("p")
    a = 1e3 * (F.col("angle_pred") - F.col("theta"))
    kind = lambda name, *values: F.struct(F.lit(name).alias("kind"), *[v.alias(k) for k, v in zip(("x", "off", "pred", "truth"), values, strict=True)])
    kinds = F.array(kind("energy", (e - t) / t, e - t, e, t), kind("angle", a, a, F.col("angle_pred"), F.col("theta")))
    slices = F.array(F.lit("all"), d_slice(F.col("d")).cast("string"))
    rows = showers.select("b", F.explode(slices).alias("slice"), "energy_pred", "p", "angle_pred", "theta").filter("slice <> '-1'").select("b", "slice", F.inline(kinds)).filter("x IS NOT NULL")
    sq = F.col("off") ** 2
    by = rows.groupBy("b", "slice", "kind").agg(F.count("*").alias("n"), F.avg("x").alias("bias"), F.stddev_samp("x").alias("sd"), F.avg(sq).alias("mse"), F.stddev_samp(sq).alias("s_sq"), es.correlation(F.col("pred"), F.col("truth")).alias("r"))
    n = F.col("n")
    lo, hi = es.t_interval(F.col("bias"), F.col("sd"), n)
    s_lo, s_hi = es.chi2_interval(F.col("sd"), n)
    m_lo, m_hi = es.t_interval(F.col("mse"), F.col("s_sq"), n)
    r_lo, r_hi = es.fisher_ci(F.when(F.abs("r") < 1, F.col("r")), n)
    return by.withColumns({
        "bias_lo": lo, "bias_hi": hi, "sd_lo": s_lo, "sd_hi": s_hi, "rmse": F.sqrt("mse"), "rmse_lo": _known(m_lo, F.sqrt(F.greatest(F.lit(0.0), m_lo))), "rmse_hi": F.sqrt(m_hi), "r_lo": r_lo, "r_hi": r_hi,
    }).drop("mse", "s_sq")
