"""Geometry of the detector, reference frames, projections, voxels and profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import with_quantiles
from .events import _mask, rotation, splat, weighted
from .filters import FOOTPRINT, PITCH, Z_FRONT, finite, own_shower, summed  # noqa: F401
from .joins import entry, event_frame, join_frame, turned

BIN = 20.0
SLAB = 2
MOST_VALUES = 10_000

# --- geometry ------------------------------------------------------------------------------------


def lattice(hits: DataFrame) -> DataFrame:
    """The sorted coordinate values of each axis with their gaps; an axis is uniform if all its gaps agree."""
    values = hits.select(F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in "xyz"]))).distinct()
    w = Window.partitionBy("axis").orderBy("value")
    gaps = values.withColumn("gap", F.col("value") - F.lag("value").over(w))
    return gaps.groupBy("axis").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), ((F.max("gap") - F.min("gap")) < 1e-6).cast("int").alias("uniform"))


def layer_pitch(hits: DataFrame) -> DataFrame:
    """The smallest gap between populated layers."""
    z = hits.select("z").distinct()
    return z.withColumn("gap", F.col("z") - F.lag("z").over(Window.orderBy("z"))).agg(F.min("gap").alias("pitch"), F.count("*").alias("n_layers"))


def footprint(hits: DataFrame) -> DataFrame:
    """Cell pitch on each side: the median of neighbouring gaps that are near their fifth percentile."""
    cells = hits.select("ix", "iy", "x", "y").distinct()
    gap = lambda a, b: cells.select((F.col(a) - F.lag(a).over(Window.partitionBy(f"i{b}").orderBy(a))).alias("gap")).filter("gap > 0").withColumn("axis", F.lit(a))
    both = gap("x", "y").unionByName(gap("y", "x"))
    low = both.groupBy("axis").agg(F.percentile("gap", 0.05).alias("low"))
    near = both.join(F.broadcast(low), "axis").filter("gap BETWEEN 0.9 * low AND 1.25 * low")
    return near.groupBy("axis").agg(F.median("gap").alias("pitch"), F.count("*").alias("n"))


def bounds(events: DataFrame) -> DataFrame:
    ends = [f(c).alias(f"{n}_{c}") for c in ("e1", "e2", "d") for n, f in (("min", F.min), ("max", F.max))]
    return events.agg(*ends, F.count_if(F.col("d").isNull()).alias("without_d"), F.countDistinct(F.col("n_ab") > 0).alias("overlap_classes"))


def running_share(df: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """Share of the total up to and including each row. Rows are bins, so a window of all of them is small."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("share", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(Window.partitionBy(*keys)))


def frame_bounds(hits: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per local coordinate: its range and the bins of 1 mm in which the energy quantiles fall."""
    long = hits.select("energy", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("c")) for a in ("xl", "yl", "zl")])))
    binned = long.groupBy("axis", F.floor("c").alias("bin")).agg(F.sum("energy").alias("e"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    s = running_share(binned, "e", "bin", "axis")
    return s.groupBy("axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.when(F.col("share") >= low, F.col("bin"))).alias("q_low"), F.min(F.when(F.col("share") >= high, F.col("bin"))).alias("q_high"))


def color_anchors(hits: DataFrame) -> DataFrame:
    """Largest and 99.9 % energy of a cell, over three binnings."""
    one = lambda name, *k: hits.groupBy(*k).agg(F.sum("energy").alias("e")).select(F.lit(name).alias("binning"), "e")
    stacked = one("xy", "ix", "iy").unionByName(one("xz", "ix", "iz")).unionByName(one("yz", "iy", "iz"))
    return with_quantiles(stacked.groupBy("binning").agg(F.max("e").alias("max_e")), stacked, ["binning"], {"p999": ("e", 0.999)})


def bin_rule(events: DataFrame) -> DataFrame:
    return events.agg(F.min("e1_bin").alias("lo"), F.max("e1_bin").alias("hi"), F.count_if(F.col("e1_bin") != F.floor("e1")).alias("off"))


# --- panels in the three frames ------------------------------------------------------------------------


def project_xy(hits: DataFrame, slab: int = SLAB) -> DataFrame:
    """Summed measures by cell of the entrance slab."""
    return summed(hits.filter(F.col("iz") <= slab), "ix", "iy")


def project_depth(hits: DataFrame) -> DataFrame:
    """Both depth panels. The sums by (ix, iy, iz) come first; the panels are roll-ups of that small table."""
    cells = hits.groupBy("ix", "iy", "iz").agg(F.sum("energy").alias("e"), F.count("*").alias("n"))
    return cells.groupingSets([["iy", "iz"], ["ix", "iz"]], "ix", "iy", "iz").agg(F.sum("e").alias("e"), F.sum("n").alias("n"), F.grouping_id().alias("panel")).select("panel", "ix", "iy", "iz", "e", "n")


def shower_frame(showers: DataFrame, kind: str = "local") -> DataFrame:
    """Rotation about the entry point of each shower: identity, or by its direction."""
    unit = {f"r{i}{j}": F.lit(1.0 if i == j else 0.0) for i in (1, 2, 3) for j in (1, 2, 3)}
    return showers.withColumns(rotation() if kind == "local" else unit)


def transform(df: DataFrame, x: str = "x", y: str = "y", z: str = "z", origin=("p0x", "p0y", "p0z")) -> DataFrame:
    """Points in the frame of their row: R (p - a)."""
    d = [F.col(c) - F.col(a) for c, a in zip((x, y, z), origin, strict=True)]
    row = lambda i: sum((F.col(f"r{i}{j}") * d[j - 1] for j in (2, 3)), F.col(f"r{i}1") * d[0])
    return df.withColumns({"u": row(1), "v": row(2), "w": row(3)})


def in_shower_frame(hits: DataFrame, showers: DataFrame, kind: str = "local") -> DataFrame:
    f = shower_frame(showers.filter("d IS NOT NULL"), kind).select("event_number", "b", "p0x", "p0y", "p0z", *[f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)])
    return transform(hits.withColumn("b", own_shower(F.col("origin"))).join(f, ["event_number", "b"]))


def resultant(cos: Column, sin: Column) -> Column:
    return F.sqrt(F.avg(cos) ** 2 + F.avg(sin) ** 2)


def frame_stats(events: DataFrame) -> DataFrame:
    """The D-frame's statistics over the selection."""
    f = event_frame(events)
    p0 = {s: entry(s, "p0") for s in "ab"}
    off = lambda s: F.sqrt((F.col(f"x{s}") - p0[s][0]) ** 2 + (F.col(f"y{s}") - p0[s][1]) ** 2)
    c, s_ = F.cos("psi"), F.sin("psi")
    slope = lambda s: (c * F.cos(f"phi_{s}") + s_ * F.sin(f"phi_{s}")) * F.tan(f"theta_{s}")
    by = f.agg(
        F.count("*").alias("n"), F.sum("n_hits").alias("n_hits"), F.avg("d_entry").alias("mean_entry"), F.stddev_samp("d_entry").alias("sd_entry"),
        F.avg("d").alias("mean_d"), F.avg(slope("a")).alias("slope_a"), F.stddev_samp(slope("a")).alias("sd_slope_a"), F.avg(slope("b")).alias("slope_b"),
        resultant(c, s_).alias("psi_resultant"), F.count_if(F.col("d_entry") < 10).alias("ill"),
    )
    return with_quantiles(by, f, [], {"median_entry": ("d_entry", 0.5), "median_d": ("d", 0.5), "anchor_p90": (off("a"), 0.9)})


def shower_stats(showers: DataFrame) -> DataFrame:
    """Moments of each shower's centroid in its frame, and the resultant of its azimuth."""
    ms = [f(c).alias(f"{n}_{c}") for c in ("cxl", "cyl", "czl") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return showers.filter("d IS NOT NULL").groupBy("b").agg(F.count("*").alias("n"), *ms, resultant(F.cos("phi"), F.sin("phi")).alias("phi_resultant"))


def accumulate_dframe(hits: DataFrame, events: DataFrame, k: int = 2, size: float = BIN, half: int = 30) -> DataFrame:
    """Energy on the D-frame grid by (jx, jy, layer); -1 on both where a deposit falls outside, so inside and outside add up."""
    h = splat(join_frame(hits, event_frame(events)), k, 1)
    dx, dy = turned(F.col("x") + F.col("ox"), F.col("y") + F.col("oy"))
    jx, jy = F.floor(dx / size) + half, F.floor(dy / size) + half
    inside = (jx >= 0) & (jx < 2 * half) & (jy >= 0) & (jy < 2 * half)
    return h.groupBy(F.when(inside, jx).otherwise(-1).alias("jx"), F.when(inside, jy).otherwise(-1).alias("jy"), F.col("iz").alias("layer")).agg(F.sum("v").alias("e"), F.count("*").alias("n"))


def box_terms(width: float, size: float) -> list[tuple[int, int, float, float]]:
    """(side, bin offset, a, b): the share a + b * phase of a box that starts `phase` into a bin, for both sides of the phase where its end changes bin."""
    m, q = math.floor(width / size), size / width
    r = width / size - m
    out = []
    for side in (0, 1):
        out += [(side, 0, q, -q)] + [(side, i, q, 0.0) for i in range(1, m)]
        out += [(0, m, q * r, q)] if side == 0 else [(1, m, q, 0.0), (1, m + 1, q * (r - 1), q)]
    return out


def accumulate_trans(hits: DataFrame, size: float = BIN, half: int = 20, w=FOOTPRINT) -> DataFrame:
    """Exact overlap of each cell with the grid of the translated frame. Hits are first summed as four moments by half-bin
    key; only that table is spread over bins, by two small lists of coefficients."""
    c = F.col
    ux, uy = (c("xt") - w[0] / 2) / size + half, (c("yt") - w[1] / 2) / size + half
    edge = [1 - (x / size - math.floor(x / size)) for x in w]
    h = hits.withColumns({"jx": F.floor(ux), "jy": F.floor(uy), "fx": ux - F.floor(ux), "fy": uy - F.floor(uy)})
    h = h.withColumns({"sx": (c("fx") >= edge[0]).cast("int"), "sy": (c("fy") >= edge[1]).cast("int")})
    e = c("energy")
    moments = h.groupBy("jx", "sx", "jy", "sy").agg(F.sum("energy").alias("m"), F.sum(e * c("fx")).alias("mx"), F.sum(e * c("fy")).alias("my"), F.sum(e * c("fx") * c("fy")).alias("mxy"))

    def coefficients(width: float, axis: str) -> Column:
        terms = [F.struct(F.lit(s).alias(f"t{axis}"), F.lit(o).alias(f"o{axis}"), F.lit(a).alias(f"a{axis}"), F.lit(b).alias(f"b{axis}")) for s, o, a, b in box_terms(width, size)]
        return F.inline(F.array(*terms))

    spread = moments.select("*", coefficients(w[0], "x")).filter("tx = sx").select("*", coefficients(w[1], "y")).filter("ty = sy")
    v = c("ax") * c("ay") * c("m") + c("bx") * c("ay") * c("mx") + c("ax") * c("by") * c("my") + c("bx") * c("by") * c("mxy")
    return spread.groupBy((c("jx") + c("ox")).alias("bx"), (c("jy") + c("oy")).alias("by")).agg(F.sum(v).alias("e"))


def accumulate_local(hits: DataFrame, k: int = 2, kz: int = 2, size: float = BIN, half: int = 30) -> DataFrame:
    """Rotated deposits on the local grid with the layer pitch as depth; -1 outside."""
    h = splat(hits.withColumns(rotation()), k, kz)
    c = F.col
    u = c("xl") + c("r11") * c("ox") + c("r12") * c("oy") + c("r13") * c("oz")
    v = c("yl") + c("r21") * c("ox") + c("r22") * c("oy")
    w = c("zl") + c("r31") * c("ox") + c("r32") * c("oy") + c("r33") * c("oz")
    ju, jv = F.floor(u / size) + half, F.floor(v / size) + half
    inside = (ju >= 0) & (ju < 2 * half) & (jv >= 0) & (jv < 2 * half)
    return h.groupBy(F.when(inside, ju).otherwise(-1).alias("ju"), F.when(inside, jv).otherwise(-1).alias("jv"), F.floor(w / PITCH).alias("jw")).agg(F.sum("v").alias("e"))


def frame_residual(hits: DataFrame) -> DataFrame:
    """Largest difference of the stored local coordinates from the rotated translated ones."""
    h = hits.withColumns(rotation())
    row = lambda i: F.col(f"r{i}1") * F.col("xt") + F.col(f"r{i}2") * F.col("yt") + F.col(f"r{i}3") * F.col("zt")
    return h.agg(F.max(F.greatest(*[F.abs(F.col(f"{a}l") - row(i)) for i, a in enumerate("xyz", 1)])).alias("residual"))


# --- voxels, cells, layers ------------------------------------------------------------------------------


def voxels(hits: DataFrame, merge: int = 2) -> DataFrame:
    """Sums by fine voxel, merged two by two across, with the largest fine sum."""
    fine = hits.groupBy("ix", "iy", "iz").agg(F.sum("energy").alias("e"), F.count("*").alias("n"))
    return fine.groupBy(F.floor(F.col("ix") / merge).alias("vx"), F.floor(F.col("iy") / merge).alias("vy"), F.col("iz").alias("vz")).agg(F.sum("e").alias("e"), F.sum("n").alias("n"), F.max("e").alias("peak"))


def voxel_rank(vox: DataFrame, cap: int = 50, floor: float = 1e-3) -> DataFrame:
    """Voxels by their ratio to the peak: drawn (the `cap` with most energy at or above the floor), over the cap, or under the floor."""
    peak = vox.agg(F.max("peak").alias("top"))
    v = vox.crossJoin(F.broadcast(peak)).withColumn("ratio", F.col("e") / F.col("top")).withColumn("faint", F.col("ratio") < floor)
    rank = F.row_number().over(Window.orderBy("faint", F.desc("e"), "vz", "vx", "vy"))
    return v.withColumn("place", rank).withColumn("class", F.when(F.col("faint"), "faint").when(F.col("place") <= cap, "drawn").otherwise("capped"))


def merge_cells(hits: DataFrame) -> DataFrame:
    """Cells of an event: energy, energy-weighted map, any primary, dominant species by energy (ties to the name) and its purity, origin code."""
    by = hits.groupBy("event_number", "cell_id", "particle_type").agg(F.sum("energy").alias("se"), F.count("*").alias("sn"), F.sum(F.col("energy") * F.col("gradcam")).alias("eg"), F.min("is_secondary").alias("sec"), F.bit_or(F.when(F.col("origin") == "A", 1).when(F.col("origin") == "B", 2).otherwise(3)).alias("org"))
    first = Window.partitionBy("event_number", "cell_id").orderBy(F.desc("se"), "particle_type")
    r = by.withColumn("place", F.row_number().over(first))
    return r.groupBy("event_number", "cell_id").agg(
        F.sum("se").alias("e"), F.sum("sn").alias("n"), (F.sum("eg") / F.sum("se")).alias("map"), (F.min("sec") == 0).cast("int").alias("any_primary"),
        F.max(F.when(F.col("place") == 1, F.col("particle_type"))).alias("species"), (F.max("se") / F.sum("se")).alias("purity"), F.bit_or("org").alias("origin_code"),
    )


def daughter_mode(hits: DataFrame) -> DataFrame:
    """The most frequent daughter of each particle type, ties by name."""
    tokens = hits.select("particle_type", F.explode(F.split("daughter_type", ";")).alias("daughter")).groupBy("particle_type", "daughter").agg(F.count("*").alias("n"))
    w = Window.partitionBy("particle_type").orderBy(F.desc("n"), "daughter")
    return tokens.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def centroids(hits: DataFrame) -> DataFrame:
    """Energy-weighted places of both showers from voxel shares (B: what A leaves), and their transverse distance."""
    a, b = F.col("energy") * F.col("seg_pred"), F.greatest(F.col("energy") - F.col("energy") * F.col("seg_pred"), F.lit(0.0))
    m = lambda w, c: F.sum(w * F.col(c)) / F.sum(w)
    out = hits.agg(*[m(w, c).alias(f"{n}{c}") for n, w in (("a", a), ("b", b)) for c in "xyz"])
    return out.withColumn("distance", F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2))


def shower_axes(hits: DataFrame, fraction: float = 0.05) -> DataFrame:
    """Transverse centroid of each layer that holds a fraction of the peak layer at least."""
    by = hits.groupBy("iz").agg(F.sum("energy").alias("e"), (F.sum(F.col("energy") * F.col("x")) / F.sum("energy")).alias("cx"), (F.sum(F.col("energy") * F.col("y")) / F.sum("energy")).alias("cy"))
    return by.withColumn("top", F.max("e").over(Window.partitionBy())).filter(F.col("e") >= fraction * F.col("top")).drop("top")


def reach(hits: DataFrame, n_layers: int = 7) -> DataFrame:
    """For each depth k from a shower's own first layer: how many showers could reach it inside the detector."""
    start = hits.groupBy("event_number", own_shower(F.col("origin")).alias("b")).agg(F.min("iz").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    k = start.sparkSession.range(n_layers).select(F.col("id").alias("k"))
    return k.join(F.broadcast(start), F.col("s") <= n_layers - 1 - F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def pool_layers(hits: DataFrame, counts=(1, 2, 4)) -> DataFrame:
    """Sums of contiguous groups of layers."""
    group, start = F.lit(len(counts)), 0
    for g, n in enumerate(counts):
        group = F.when(F.col("iz").between(start, start + n - 1), g).otherwise(group)
        start += n
    return hits.groupBy(group.alias("grp")).agg(F.sum("energy").alias("e"), F.count("*").alias("n"), F.countDistinct("iz").alias("layers"))


def fit_window(marginal: DataFrame, low: float = 0.005, high: float = 0.995, least: int = 2) -> DataFrame:
    """A window about zero that holds the bins (bin, e) between two energy shares, and the energy outside it."""
    s = running_share(marginal, "e", "bin")
    half = s.agg(F.greatest(F.lit(least), F.greatest(-F.min(F.when(F.col("share") >= low, F.col("bin"))), F.min(F.when(F.col("share") >= high, F.col("bin"))))).alias("half"))
    return marginal.crossJoin(F.broadcast(half)).groupBy("half").agg(F.coalesce(F.sum(F.when((F.col("bin") < -F.col("half")) | (F.col("bin") > F.col("half")), F.col("e"))), F.lit(0.0)).alias("outside"), F.sum("e").alias("total"))


def islands(marginal: DataFrame, gap: int = 2) -> DataFrame:
    """Runs of populated bins that gaps of more than `gap` empty bins part, with the energy share of each."""
    w = Window.orderBy("bin")
    cut = F.when(F.col("bin") - F.lag("bin").over(w) > gap, 1).otherwise(0)
    runs = marginal.withColumn("cut", cut).withColumn("island", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = runs.groupBy("island").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.sum("e").alias("e"))
    return by.withColumn("share", F.col("e") / F.sum("e").over(Window.partitionBy()))


def cap_windows(cells: DataFrame, floor: float = 1e-3, low: float = 1e-3, high: float = 0.999, least: float = 200.0, extent: float = 0.0, gap: float = FOOTPRINT[0], island: float = 1e-3, size: float = BIN) -> DataFrame:
    """The window about zero of each panel's first axis, from cells (panel, i, j, e) of bins of `size`, cut where only islands lie
    beyond, and what is drawn outside it.

    A window holds the energy between two shares of the panel. Cells at a ratio `floor` to the panel's peak are drawn; runs of
    drawn bins that gaps of more than `gap` part are components, and one with less than `island` of the drawn energy is an
    island (all count where all are that small). The outer edge of the others and `extent`, in whole bins and not under
    `least`, is the limit, which only ever tightens the window. `share_out` is of the panel's energy, and n, e and at (the
    centre of energy along the second axis) are of drawn cells beyond either end. Cells without energy take no part."""
    panel, i = Window.partitionBy("panel"), F.col("i")
    own = cells.filter("e > 0").withColumn("shown", F.col("e") >= floor * F.max("e").over(panel))
    shown = lambda x: F.sum(F.when(F.col("shown"), x))
    bins = own.groupBy("panel", "i").agg(F.sum("e").alias("e"), F.coalesce(shown(F.lit(1)), F.lit(0)).alias("dn"), F.coalesce(shown(F.col("e")), F.lit(0.0)).alias("de"), F.coalesce(shown(F.col("e") * (F.col("j") + 0.5) * size), F.lit(0.0)).alias("dm"))
    outer = lambda a, b: F.greatest(F.abs(a * size), F.abs((b + 1) * size))
    snap = lambda x: F.greatest(F.lit(least), F.ceil(x / size - 1e-9) * size)
    share = running_share(bins, "e", "i", "panel")
    first = lambda p: F.min(F.when(F.col("share") >= p, i))
    plain = share.groupBy("panel").agg(snap(outer(first(low), first(high))).alias("half_plain"), F.sum("e").alias("total"))
    order = panel.orderBy("i")
    runs = bins.filter("dn > 0").withColumn("cut", F.when(i - F.lag("i").over(order) - 1 > int(gap / size + 1e-9), 1).otherwise(0)).withColumn("run", F.sum("cut").over(order))
    parts = runs.groupBy("panel", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.sum("de").alias("de"))
    parts = parts.withColumn("large", F.col("de") >= island * F.sum("de").over(panel))
    parts = parts.withColumn("kept", F.col("large") | ~F.max("large").over(panel))
    drawn = parts.groupBy("panel").agg(F.count("*").alias("components"), F.count_if("kept").alias("kept"), F.max(F.when(F.col("kept"), outer(F.col("a"), F.col("b")))).alias("half_drawn"))
    ends = plain.join(drawn, "panel").withColumn("cap", snap(F.col("half_drawn") + extent))
    ends = ends.withColumns({"applied": (F.col("cap") < F.col("half_plain") - 1e-9).cast("int"), "half": F.least("cap", "half_plain")})
    under, over = (i + 1) * size <= -F.col("half") + 1e-9, i * size >= F.col("half") - 1e-9
    some = lambda side, x: F.coalesce(F.sum(F.when(side, F.col(x))), F.lit(0))
    facts = ["panel", "components", "kept", "half_plain", "half_drawn", "applied", "half", "total"]
    out = bins.join(ends, "panel").groupBy(*facts).agg(
        (some(under | over, "e") / F.col("total")).alias("share_out"), *[some(side, x).alias(f"{name}_{end}") for end, side in (("lo", under), ("hi", over)) for name, x in (("n", "dn"), ("e", "de"), ("m", "dm"))]
    )
    return out.withColumns({f"at_{end}": F.try_divide(f"m_{end}", f"e_{end}") for end in ("lo", "hi")}).drop("total", "m_lo", "m_hi")


def kernel_resample(marginal: DataFrame, sigma: float = 1.0, reach_: int = 3) -> DataFrame:
    """Bins spread by a Gaussian whose weights add up to one."""
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach_, reach_ + 1)]
    taps = F.array(*[F.struct(F.lit(d).alias("off"), F.lit(x / sum(raw)).alias("wt")) for d, x in zip(range(-reach_, reach_ + 1), raw, strict=True)])
    return marginal.select("bin", "e", F.inline(taps)).groupBy((F.col("bin") + F.col("off")).alias("bin")).agg(F.sum(F.col("e") * F.col("wt")).alias("e"))


def top_cells(df: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    """The k largest by magnitude; what agrees in nine digits is a tie."""
    return df.orderBy(F.desc(F.abs(F.round(value, 9))), *ties).limit(k)


def detrend(marginal: DataFrame, bins: int = 9) -> DataFrame:
    """Bins less their moving mean, with the one before."""
    h, w = bins // 2, Window.orderBy("bin")
    d = marginal.withColumn("rest", F.col("e") - F.avg("e").over(w.rowsBetween(-h, h)))
    return d.withColumn("before", F.lag("rest").over(w))


def comb(marginal: DataFrame, threshold: float = -0.10) -> DataFrame:
    """Whether neighbouring bins alternate: lag-1 correlation of the detrended bins."""
    return detrend(marginal).agg(F.corr("rest", "before").alias("lag1"), F.count("*").alias("n")).withColumn("comb", (F.col("lag1") < threshold).cast("int"))


def principal_axis(hits: DataFrame, keys=("event_number",)) -> DataFrame:
    """Largest eigenvalue of the energy-weighted covariance of each group (closed form of a symmetric 3x3 matrix), its share, and the angle of its axis to the depth."""
    e, total = F.col("energy"), F.sum("energy")
    at = {"x": F.col("x"), "y": F.col("y"), "z": F.col("z") - Z_FRONT}  # far from the origin, squares would lose digits
    mean = lambda c: F.sum(e * at[c]) / total
    cov = lambda a, b: F.sum(e * at[a] * at[b]) / total - mean(a) * mean(b)
    s = hits.groupBy(*keys).agg(F.count("*").alias("n"), *[cov(a, b).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])
    c = F.col
    q = (c("xx") + c("yy") + c("zz")) / 3
    p2 = ((c("xx") - q) ** 2 + (c("yy") - q) ** 2 + (c("zz") - q) ** 2 + 2 * (c("xy") ** 2 + c("xz") ** 2 + c("yz") ** 2)) / 6
    s = s.withColumns({"q": q, "pp": F.sqrt(F.greatest(p2, F.lit(0.0)))})
    a, b, d = c("xx") - c("q"), c("yy") - c("q"), c("zz") - c("q")
    det = a * (b * d - c("yz") ** 2) - c("xy") * (c("xy") * d - c("yz") * c("xz")) + c("xz") * (c("xy") * c("yz") - b * c("xz"))
    half = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, 2 * c("pp") ** 3)))
    s = s.withColumn("largest", F.when(c("pp") < 1e-9, c("q")).otherwise(c("q") + 2 * c("pp") * F.cos(F.acos(half) / 3)))
    # The principal minors of M - m are the squared components of the first axis, up to one factor: the gaps' product.
    m = c("largest")
    minor = lambda i, j: F.greatest(F.lit(0.0), (c(i + i) - m) * (c(j + j) - m) - c("".join(sorted(i + j))) ** 2)
    across, along = F.sqrt(minor("y", "z") + minor("x", "z")), F.sqrt(minor("x", "y"))
    known = (c("q") > 1e-3) & (across**2 + along**2 > 1e-6 * c("q") ** 2)  # one place, or no axis above the others: no angle
    return s.withColumns({"share": F.when(c("q") > 1e-3, m / (3 * c("q"))), "angle": F.when(known, F.atan2(across, along))})


def event_panels(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Energy panels of the events chosen in `events`, in all frames, by plane and bin."""
    planes = [(f"{name}_{a}{b}", a + f, b + f) for name, f in (("lab", ""), ("trans", "t"), ("local", "l")) for a, b in ("xy", "xz", "yz")]
    rows = F.array(*[F.struct(F.lit(n).alias("panel"), F.floor(F.col(a) / BIN).alias("i"), F.floor(F.col(b) / BIN).alias("j")) for n, a, b in planes])
    return hits.join(events.select("event_number"), "event_number", "left_semi").select("event_number", "energy", F.inline(rows)).groupBy("event_number", "panel", "i", "j").agg(F.sum("energy").alias("e"))


def density(cells: DataFrame, n_events: DataFrame, area: float) -> DataFrame:
    """Energy per event and area, and the panel's peak."""
    d = cells.crossJoin(F.broadcast(n_events)).withColumn("density", F.col("m_e") / (F.col("n_events") * area))
    return d.withColumn("peak", F.max("density").over(Window.partitionBy()))


def floor_mask(cells: DataFrame, floor: float = 1e-1) -> DataFrame:
    """How many cells stay at a ratio to the peak, and the energy of those masked."""
    c = cells.withColumn("ratio", F.col("m_e") / F.max("m_e").over(Window.partitionBy()))
    return c.agg(F.count_if(F.col("ratio") >= floor).alias("drawn"), F.count_if(F.col("ratio") < floor).alias("masked"), F.coalesce(F.sum(F.when(F.col("ratio") < floor, F.col("m_e"))), F.lit(0.0)).alias("masked_e"))


def event_window(hits: DataFrame, low: float = 0.05, high: float = 0.95, pad: float = 1.0) -> DataFrame:
    """Padded energy quantiles of each event's x, and what lies outside."""
    w = Window.partitionBy("event_number")
    upto = F.sum("energy").over(w.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)) / F.sum("energy").over(w)
    h = hits.withColumn("share", upto)
    h = h.withColumns({"lo": F.min(F.when(F.col("share") >= low, F.col("x"))).over(w) - pad, "hi": F.min(F.when(F.col("share") >= high - 1e-9, F.col("x"))).over(w) + pad})
    out = ~F.col("x").between(F.col("lo"), F.col("hi"))
    return h.groupBy("event_number").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.count_if(out).alias("n_out"), F.coalesce(F.sum(F.when(out, F.col("energy"))), F.lit(0.0)).alias("e_out"))


def event_attention(hits: DataFrame) -> DataFrame:
    """Energy-weighted map of each event and layer, its signed parts apart."""
    v = F.col("energy") * F.col("shapcam")
    return hits.groupBy("event_number", "iz").agg(F.sum(F.greatest(v, F.lit(0.0))).alias("up"), F.sum(F.least(v, F.lit(0.0))).alias("down"), F.sum("energy").alias("e"))
