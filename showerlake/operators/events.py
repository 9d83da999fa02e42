"""Tables derived per event: additive sums, so that any selection is a roll-up of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import AXES, FRAMES, PITCH, finite, group_key, own_shower  # noqa: F401

NEGATIVE_DEPTH = -0.5 * PITCH
EPS = 1e-6
R_BIN, R_BINS = 10.0, 50
K, K_Z = 6, 2


def _mask(shower: str, both: bool = False) -> Column:
    """Rows of a shower: A+B counts with B; for the entry point (both) it counts with either."""
    o = F.col("origin")
    if both:
        return o != ("B" if shower == "a" else "A")
    return o == "A" if shower == "a" else o != "A"


def where(mask: Column, c: Column | str) -> Column:
    return F.when(mask, F.col(c) if isinstance(c, str) else c)


def weighted(mask: Column, c: str) -> Column:
    return F.try_divide(F.sum(where(mask, F.col("energy") * F.col(c))), F.sum(where(mask, "energy")))


def entry_point(s: str) -> dict[str, Column]:
    return {f"p0{s}{a}": F.avg(where(_mask(s, True), F.col(a) - F.col(f"{a}t"))) for a in AXES}


def segmentation_sums(threshold: float = 0.5) -> dict[str, Column]:
    e, p, t = F.col("energy"), F.col("seg_pred"), F.col("seg_true")
    return {
        "e_a_pred": F.sum(e * p), "e_b_pred": F.sum(e * (1 - p)), "e_a_true": F.sum(e * t), "e_b_true": F.sum(e * (1 - t)), "abs_err": F.sum(F.abs(p - t)),
        "wabs_err": F.sum(e * F.abs(p - t)), "sq_err": F.sum((p - t) * (p - t)), "n_correct": F.count_if((p >= threshold) == (t >= threshold)),
        "n_true": F.count_if(t >= threshold), "n_pred": F.count_if(p >= threshold), "n_tp": F.count_if((p >= threshold) & (t >= threshold)),
    }


def events_two(hits: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per event of two showers, in one pass over its hits; with `only`, no other sums are taken, nor their columns needed."""
    cols: dict[str, Column] = {
        "e1": F.max("p_a"), "e2": F.max("p_b"), "e1_bin": F.max("bin_a"), "e2_bin": F.max("bin_b"), "theta_a": F.max("theta_a"), "theta_b": F.max("theta_b"),
        "phi_a": F.max("phi_a"), "phi_b": F.max("phi_b"), "n_hits": F.count("*"), "n_a": F.count_if(F.col("origin") == "A"), "n_b": F.count_if(F.col("origin") == "B"),
        "n_ab": F.count_if(F.col("origin") == "A+B"), "e_dep": F.sum("energy"), "e_ab": F.coalesce(F.sum(where(F.col("origin") == "A+B", "energy")), F.lit(0.0)),
    }
    for s in "ab":
        cols |= entry_point(s)
        cols |= {f"e_own_{s}": F.coalesce(F.sum(where(_mask(s), "energy")), F.lit(0.0)), f"n_own_{s}": F.count_if(_mask(s))}
        cols |= {f"c{s}{a}{f}": weighted(_mask(s), f"{a}{f}") for f in FRAMES for a in AXES}
        cols |= {f"{c}_{s}": F.max(where(_mask(s), c)) for c in ("energy_pred", "angle_pred")}
    cols |= segmentation_sums()
    frames = [f for f in FRAMES if only is None or (f"d_{f}" if f else "d") in only]
    if only is not None:
        wanted = {*only, *[f"c{s}{a}{f}" for f in frames for s in "ab" for a in AXES]}
        cols = {n: c for n, c in cols.items() if n in wanted}
    out = hits.groupBy("event_number").agg(*[c.alias(n) for n, c in cols.items()])
    gap = lambda f: F.sqrt(sum(((F.col(f"ca{a}{f}") - F.col(f"cb{a}{f}")) ** 2 for a in AXES), F.lit(0.0)))
    return out.withColumns({"d" if not f else f"d_{f}": gap(f) for f in frames})


def events_single(hits: DataFrame) -> DataFrame:
    """One row per event of one shower."""
    everything = F.lit(True)
    primary = F.col("is_secondary") == 0
    cols = {
        "p": F.max("p"), "p_bin": F.max("p_bin"), "theta": F.max("theta"), "phi": F.max("phi"), "n_hits": F.count("*"), "e_dep": F.sum("energy"),
        "p0x": F.avg(F.col("x") - F.col("xt")), "p0y": F.avg(F.col("y") - F.col("yt")), "p0z": F.avg(F.col("z") - F.col("zt")),
        "n_primary": F.count_if(primary), "e_primary": F.coalesce(F.sum(where(primary, "energy")), F.lit(0.0)),
        "n_parent_mismatch": F.count_if((F.col("is_secondary") == 0) != F.col("parent_type").isNull()),
        "primary_type": F.max_by(where(primary, "particle_type"), where(primary, F.struct("energy", -F.col("cell_id")))),
    }
    cols |= {f"c{a}{f}": weighted(everything, f"{a}{f}") for f in FRAMES for a in AXES}
    return hits.groupBy("event_number").agg(*[c.alias(n) for n, c in cols.items()])


def zero_mask(hits: DataFrame, maps=("gradcam", "shapcam")) -> DataFrame:
    """A bit for each map that is zero over the whole event."""
    bits = sum((F.when(F.max(F.abs(m)) == 0, 1 << i).otherwise(0) for i, m in enumerate(maps)), F.lit(0))
    return hits.groupBy("event_number").agg(bits.alias("zero_mask"))


def spreads(hits: DataFrame) -> DataFrame:
    """Largest spread, per event, of values that must be constant in a shower."""
    each = [F.coalesce(F.max(where(_mask(s), c)) - F.min(where(_mask(s), c)), F.lit(0.0)) for s in "ab" for c in ("energy_pred", "angle_pred", "p", "theta")]
    p0 = [F.coalesce(F.max(where(_mask(s), F.col(a) - F.col(f"{a}t"))) - F.min(where(_mask(s), F.col(a) - F.col(f"{a}t"))), F.lit(0.0)) for s in "ab" for a in AXES]
    return hits.groupBy("event_number").agg(F.greatest(*each).alias("model_spread"), F.greatest(*p0).alias("p0_spread"))


def cell_census(hits: DataFrame) -> DataFrame:
    """Cells of each event, the cells of both showers, and those whose two rows do not split the cell's energy by origin."""
    cell = hits.groupBy("event_number", "cell_id").agg(F.count("*").alias("n"), F.sum("energy").alias("e"), F.countDistinct("origin").alias("origins"))
    return cell.groupBy("event_number").agg(F.count("*").alias("n_cells"), F.count_if(F.col("n") > 1).alias("n_split"), F.count_if((F.col("n") > 1) & (F.col("origins") < F.col("n"))).alias("n_bad_split"), F.max("e").alias("max_cell"))


def radius(f: str) -> Column:
    return F.sqrt(F.col(f"x{f}") ** 2 + F.col(f"y{f}") ** 2 + F.col(f"z{f}") ** 2)


def shape_sums(hits: DataFrame, keys=("event_number",), more: dict[str, Column] | None = None) -> DataFrame:
    """Additive sums of each group's shape in three frames, see `features`; with any `more` aggregates of the same pass."""
    e = F.col("energy")
    placed = hits
    for f in FRAMES:
        placed = placed.withColumn(f"r_{f}", radius(f))
        cos = F.col(f"z{f}") / F.when(F.col(f"r_{f}") == 0, EPS).otherwise(F.col(f"r_{f}"))
        placed = placed.withColumns({f"th_{f}": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))), f"ph_{f}": F.atan2(f"y{f}", f"x{f}")})
    rho2 = F.col("xl") ** 2 + F.col("yl") ** 2
    neg = F.col("zl") < NEGATIVE_DEPTH
    cols: dict[str, Column] = {"n": F.count("*"), "e": F.sum("energy"), "n_neg": F.count_if(neg), "e_neg": F.coalesce(F.sum(where(neg, "energy")), F.lit(0.0)), "e_rho": F.sum(e * F.sqrt(rho2)), "e_rho2": F.sum(e * rho2)}
    for f in FRAMES:
        for a in AXES:
            c = f"{a}{f}"
            cols |= {f"min_{c}": F.min(c), f"max_{c}": F.max(c), f"sum_e{c}": F.sum(e * F.col(c))}
        r, th, ph = f"r_{f}", f"th_{f}", f"ph_{f}"
        cols |= {
            f"sum_r_{f}": F.sum(r), f"sum_r2_{f}": F.sum(F.col(r) ** 2), f"sd_r_{f}": F.stddev_samp(r), f"max_r_{f}": F.max(r), f"sum_er_{f}": F.sum(e * F.col(r)),
            f"sum_th_{f}": F.sum(th), f"sd_th_{f}": F.stddev_samp(th), f"sum_ph_{f}": F.sum(ph), f"sd_ph_{f}": F.stddev_samp(ph), f"sum_c_{f}": F.sum(F.cos(ph)), f"sum_s_{f}": F.sum(F.sin(ph)),
        }
    return placed.groupBy(*keys).agg(*[c.alias(n) for n, c in (cols | (more or {})).items()])


FEATURES = ("width", "height", "depth", "depth_range", "volume", "centroid_x", "centroid_y", "centroid_z", "mean_r", "std_r", "max_r", "weighted_r", "avg_theta", "avg_phi", "spread", "number_density", "energy_density")


def features(sums: DataFrame, frame: str = "l", prefix: str = "") -> DataFrame:
    """17 shape features of each row of sums in one frame, with a floor of 1e-6 on lengths."""
    f, c = frame, F.col
    floor = lambda x: F.greatest(x, F.lit(EPS))
    flat = c(f"sum_r_{f}") == 0
    width, height = floor(c(f"max_x{f}") - c(f"min_x{f}")), floor(c(f"max_y{f}") - c(f"min_y{f}"))
    depth = floor(c(f"max_z{f}"))
    volume = width * height * depth
    some = lambda x: F.when(flat, 0.0).otherwise(x)
    values = (
        width, height, depth, floor(c(f"max_z{f}") - c(f"min_z{f}")), volume, c(f"sum_ex{f}") / c("e"), c(f"sum_ey{f}") / c("e"), c(f"sum_ez{f}") / c("e"),
        some(c(f"sum_r_{f}") / c("n")), some(c(f"sd_r_{f}")), some(c(f"max_r_{f}")), c(f"sum_er_{f}") / c("e"), some(c(f"sum_th_{f}") / c("n")), some(c(f"sum_ph_{f}") / c("n")),
        some(c(f"sd_th_{f}") + c(f"sd_ph_{f}")), c("n") / volume, c("e") / volume,
    )
    return sums.withColumns({prefix + n: v for n, v in zip(FEATURES, values, strict=True)})


def circular_of_sums(sums: DataFrame, frame: str = "l") -> DataFrame:
    """Mean direction, resultant and circular deviation of the hits' azimuths, and the angular spread that uses it."""
    s, c, n = F.col(f"sum_s_{frame}"), F.col(f"sum_c_{frame}"), F.col("n")
    r = F.sqrt(s**2 + c**2) / n
    sd = F.sqrt(F.greatest(F.lit(0.0), -2 * F.ln(F.least(F.lit(1.0), r))))
    return sums.withColumns({"circ_mean": F.atan2(s, c), "resultant": r, "circ_sd": sd, "spread_circ": F.col(f"sd_th_{frame}") + sd})


def events_features(df: DataFrame) -> DataFrame:
    """Checked load of feature rows: repeated ids, values that are not finite (counted; they are null), the label."""
    names = [n for n, t in df.dtypes if t == "double"]
    clean = df.withColumns({n: F.when(finite(F.col(n)), F.col(n)) for n in names})
    return clean.agg((F.count("*") - F.countDistinct("event_number")).alias("repeated"), F.sum(sum((F.col(n).isNull().cast("int") for n in names), F.lit(0))).alias("nulled"), F.count("*").alias("n"), F.count_if(F.col("p") >= 2).alias("n_label"))


def layers(hits: DataFrame, pitch: float = PITCH) -> DataFrame:
    """Per event, shower and own layer: sums of energy, hits, transverse place and radius moments."""
    e, rho2 = F.col("energy"), F.col("xt") ** 2 + F.col("yt") ** 2
    return hits.groupBy("event_number", own_shower(F.col("origin")).alias("b"), F.round(F.col("zt") / pitch).cast("int").alias("layer")).agg(
        F.sum("energy").alias("e"), F.count("*").alias("n"), F.sum(e * F.col("xt")).alias("e_u"), F.sum(e * F.col("yt")).alias("e_v"), F.sum(e * F.sqrt(rho2)).alias("e_rho"), F.sum(e * rho2).alias("e_rho2"),
    )


def splat(hits: DataFrame, k: int, kz: int, w=(48.6, 50.5, PITCH), value: str = "energy") -> DataFrame:
    """Each hit as k*k*kz deposits over its cell: offsets ox, oy, oz and an equal share v. A literal of fixed size, so no shuffle."""
    at = lambda i, n, width: ((i + 0.5) / n - 0.5) * width
    cells = [(at(i, k, w[0]), at(j, k, w[1]), at(m, kz, w[2])) for i in range(k) for j in range(k) for m in range(kz)]
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, ("ox", "oy", "oz"), strict=True)]) for c in cells])
    return hits.withColumn("v", F.col(value) / len(cells)).select("*", F.inline(offsets))


def rotation(t: str = "theta", p: str = "phi") -> dict[str, Column]:
    st, ct, sp, cp = F.sin(t), F.cos(t), F.sin(p), F.cos(p)
    return {"r11": ct * cp, "r12": ct * sp, "r13": -st, "r21": -sp, "r22": cp, "r23": F.lit(0.0), "r31": st * cp, "r32": st * sp, "r33": ct}


def profiles(hits: DataFrame, k: int = K, kz: int = K_Z, pitch: float = PITCH) -> DataFrame:
    """Energy per event, shower and bin of depth (axis 0) and of radius (axis 1, the last bin open), in the local frame."""
    h = splat(hits.withColumns(rotation() | {"b": own_shower(F.col("origin")), "neg": F.col("zl") < NEGATIVE_DEPTH}), k, kz)
    c = F.col
    u = c("xl") + c("r11") * c("ox") + c("r12") * c("oy") + c("r13") * c("oz")
    v = c("yl") + c("r21") * c("ox") + c("r22") * c("oy")
    w = c("zl") + c("r31") * c("ox") + c("r32") * c("oy") + c("r33") * c("oz")
    h = h.withColumns({"jw": F.floor(w / pitch).cast("int"), "jr": F.least(F.floor(F.sqrt(u * u + v * v) / R_BIN), F.lit(R_BINS)).cast("int")})
    # One sum per pair of bins first: both axes are roll-ups of it, and the splat is not expanded twice.
    cell = h.groupBy("event_number", "b", "jw", "jr").agg(F.sum("v").alias("e"), F.coalesce(F.sum(F.when(c("neg"), c("v"))), F.lit(0.0)).alias("e_neg"))
    axes = F.array(F.struct(F.lit(0).alias("axis"), c("jw").alias("bin")), F.struct(F.lit(1).alias("axis"), c("jr").alias("bin")))
    return cell.select("event_number", "b", F.inline(axes), "e", "e_neg").groupBy("event_number", "b", "axis", "bin").agg(F.sum("e").alias("e"), F.sum("e_neg").alias("e_neg"))


def calibration(showers: DataFrame) -> DataFrame:
    """Momentum over deposit of each shower: sums first, then one division."""
    return showers.groupBy("b").agg(F.sum("p").alias("sum_p"), F.sum("e_own").alias("sum_e"), F.try_divide(F.sum("p"), F.sum("e_own")).alias("c"))


def reconstruct(showers: DataFrame, fraction: float = 0.01) -> DataFrame:
    """Deposits over a sampling fraction as energy, and its relative residual."""
    reco = F.col("e_own") / fraction
    return showers.select("event_number", "b", "p", reco.alias("e_reco"), ((reco - F.col("p")) / F.col("p")).alias("residual"))


def species(hits: DataFrame, most: int = 6) -> DataFrame:
    """Cells, energy and primary cells of each particle type, with its share; the largest few."""
    by = hits.groupBy(F.coalesce("particle_type", F.lit("unknown")).alias("species")).agg(F.count("*").alias("n"), F.sum("energy").alias("e"), F.count_if(F.col("is_secondary") == 0).alias("n_primary"))
    total = hits.agg(F.sum("energy").alias("total"))
    return by.crossJoin(F.broadcast(total)).withColumn("share", F.col("e") / F.col("total")).drop("total").orderBy(F.desc("e"), "species").limit(most)


def to_shower_frame(hits: DataFrame) -> DataFrame:
    """Recentred on each event's entry layer: its own layer from there, and places relative to that layer's energy centroid."""
    w = Window.partitionBy("event_number")
    h = hits.withColumn("entry", F.min("iz").over(w)).withColumn("on_entry", F.col("iz") == F.min("iz").over(w))
    e0 = F.sum(where(F.col("on_entry"), "energy")).over(w)
    centre = lambda a: F.sum(where(F.col("on_entry"), F.col("energy") * F.col(a))).over(w) / e0
    return h.withColumns({"rx": F.col("x") - centre("x"), "ry": F.col("y") - centre("y"), "own_layer": F.col("iz") - F.col("entry"), "n_entry": F.count_if("on_entry").over(w), "front": F.col("entry") == 0})


def artifacts(hits: DataFrame) -> DataFrame:
    """Events with one entry hit, hits at the origin of the shower frame and events that start at the front face, with fractions."""
    h = to_shower_frame(hits)
    by = h.groupBy("event_number").agg(F.max("n_entry").alias("n_entry"), F.max("front").alias("front"), F.count_if((F.abs("rx") < 1e-9) & (F.abs("ry") < 1e-9) & (F.col("own_layer") == 0)).alias("at_origin"))
    return by.agg(F.count("*").alias("n"), F.count_if(F.col("n_entry") == 1).alias("one_entry"), F.sum("at_origin").alias("at_origin"), F.count_if("front").alias("front"), (F.count_if(F.col("n_entry") == 1) / F.count("*")).alias("one_entry_share"))


def shower_axis(hits: DataFrame) -> DataFrame:
    """Energy-weighted straight line through the layers' energy centroids."""
    by = hits.groupBy("z").agg(F.sum("energy").alias("w"), (F.sum(F.col("energy") * F.col("x")) / F.sum("energy")).alias("cx"), (F.sum(F.col("energy") * F.col("y")) / F.sum("energy")).alias("cy"))
    by = by.withColumn("z", F.col("z") - 3662.4)
    s = lambda *names: F.sum(_product("w", *names))
    sums = by.agg(*[s(*n).alias(k) for k, n in {"w": (), "z": ("z",), "zz": ("z", "z"), "x": ("cx",), "zx": ("z", "cx"), "y": ("cy",), "zy": ("z", "cy")}.items()])
    det = F.col("w") * F.col("zz") - F.col("z") ** 2
    slope = lambda a: (F.col("w") * F.col(f"z{a}") - F.col("z") * F.col(a)) / det
    return sums.select(slope("x").alias("slope_x"), slope("y").alias("slope_y"), ((F.col("x") - slope("x") * F.col("z")) / F.col("w")).alias("x0"), ((F.col("y") - slope("y") * F.col("z")) / F.col("w")).alias("y0"))


def _product(*names: str) -> Column:
    out = F.col(names[0])
    for n in names[1:]:
        out = out * F.col(n)
    return out


def sample10(hits: DataFrame) -> DataFrame:
    """A stable tenth of the rows by their keys."""
    return hits.filter((F.col("event_number") * 7919 + F.col("cell_id")) % 10 == 0)
