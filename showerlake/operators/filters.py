"""Predicates, classes and derived columns of hits, events and showers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
FRAMES = {"": "lab", "t": "trans", "l": "local"}
D_EDGES = (50.0, 100.0, 150.0, 200.0)
PITCH = 20.5
Z_FRONT = 3662.4
FOOTPRINT = (48.6, 50.5)
N_GROUPS = 64


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def coordinates() -> list[str]:
    return [f"{a}{f}" for f in FRAMES for a in AXES]


def hit_rule(origin: bool = True) -> Column:
    """Finite coordinates in every frame, finite positive energy and (two showers) a known origin."""
    rule = finite(F.col("energy")) & (F.col("energy") > 0)
    for c in coordinates():
        rule &= finite(F.col(c))
    return rule & F.col("origin").isin("A", "B", "A+B") if origin else rule


def keep_hits(df: DataFrame, origin: bool = True) -> DataFrame:
    """The rows that the rule of hits lets through."""
    return df.filter(hit_rule(origin))


def audit_hits(df: DataFrame) -> DataFrame:
    """How many rows each rule of keep_hits rejects by itself, and how many are kept, in one pass."""
    e = F.col("energy")
    bad = ~finite(F.col(coordinates()[0]))
    for c in coordinates()[1:]:
        bad |= ~finite(F.col(c))
    odd = ~F.coalesce(F.col("origin").isin("A", "B", "A+B"), F.lit(False))
    rules = {"bad_coordinate": bad, "bad_energy": ~finite(e), "no_energy": F.coalesce(e <= 0, F.lit(False)), "bad_origin": odd}
    kept = ~(bad | ~finite(e) | F.coalesce(e <= 0, F.lit(True)) | odd)
    return df.agg(F.count("*").alias("rows"), *[F.count_if(r).alias(n) for n, r in rules.items()], F.count_if(kept).alias("kept"))


def sanitize_batch(df: DataFrame, columns: tuple[str, ...] = ("x", "y", "z", "energy")) -> DataFrame:
    """Coerce to numbers, then count what each rule drops in turn: not finite, no energy, in front of the origin; with spans for unit checks."""
    df = df.select(*[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in columns])
    ok = finite(F.col(columns[0]))
    for c in columns[1:]:
        ok &= finite(F.col(c))
    charged, behind = ok & (F.col("energy") > 0), ok & (F.col("energy") > 0) & (F.col("z") < 0)
    span = lambda c: F.max(F.when(charged, F.col(c))) - F.min(F.when(charged, F.col(c)))
    return df.agg(
        F.count_if(~ok).alias("not_finite"), F.count_if(ok & (F.col("energy") <= 0)).alias("no_energy"), F.count_if(behind).alias("negative_z"),
        F.count_if(charged & (F.col("z") >= 0)).alias("kept"), span("x").alias("span_x"), span("y").alias("span_y"), span("z").alias("span_z"), F.max("energy").alias("max_energy"),
    )


def select(df: DataFrame, e1=None, e2=None, d=None, include_undefined_d: bool = False) -> DataFrame:
    """Inclusive bounds on the momenta and the separation; an undefined separation is out unless asked for. None: no bound."""
    for name, bounds in (("e1", e1), ("e2", e2), ("d", d)):
        if bounds:
            rule = F.col(name).between(*map(F.lit, bounds))
            df = df.filter(rule | F.col(name).isNull() if name == "d" and include_undefined_d else rule)
    return df


def particle_filter(events: DataFrame, p=(0.0, 1e9), theta_deg=(0.0, 180.0)) -> DataFrame:
    """Events of which a present shower has both its momentum and its angle within the bounds."""
    match = F.lit(False)
    for s, mom in (("a", "e1"), ("b", "e2")):
        hit = (F.col(f"n_own_{s}") > 0) & F.col(mom).between(*p) & F.degrees(f"theta_{s}").between(*theta_deg)
        match |= F.coalesce(hit, F.lit(False))
    return events.filter(match)


def frame_gate(kind: str = "two") -> Column:
    """Events that have a frame: a separation, or (one shower) a direction and an entry point."""
    names = ["d"] if kind == "two" else ["theta", "phi", "p0x", "p0y", "p0z"]
    rule = F.col(names[0]).isNotNull()
    for n in names[1:]:
        rule &= F.col(n).isNotNull()
    return rule


SHOWER_COLUMNS = ("p", "bin", "theta", "phi", "e_own", "n_own", "p0x", "p0y", "p0z", "cx", "cy", "cz", "cxt", "cyt", "czt", "cxl", "cyl", "czl", "energy_pred", "angle_pred")


def showers(events: DataFrame, which: str = "both", columns: tuple[str, ...] = SHOWER_COLUMNS) -> DataFrame:
    """One row per event and shower that is present (b: 0 for A, 1 for B), with its own attributes, or the named ones alone."""
    own_columns = dict.fromkeys((*columns, "n_own"))

    def own(s: str) -> Column:
        from_ = {"p": "e1" if s == "a" else "e2", "bin": "e1_bin" if s == "a" else "e2_bin"}
        name = lambda c: from_.get(c) or (f"p0{s}{c[2]}" if c.startswith("p0") else f"c{s}{c[1:]}" if c[0] == "c" else f"{c}_{s}")
        return F.struct(F.lit("ab".index(s)).alias("b"), *[F.col(name(c)).alias(c) for c in own_columns])

    keys = {"a": "a", "b": "b"}.get(which, "ab")
    rows = events.select("event_number", "d", "e1", "e2", F.explode(F.array(*[own(s) for s in keys])).alias("s"))
    return rows.select("event_number", "d", "e1", "e2", "s.*").filter("n_own > 0")


def own_shower(origin: Column) -> Column:
    return F.when(origin == "A", 0).otherwise(1)


def frame_xyz(df: DataFrame, frame: str, x_values=None, pitch: float = PITCH) -> DataFrame:
    """u, v, w of each hit: local; translated, with the depth as layer times pitch; or laboratory, looked up in the lattice's values (x is not uniform)."""
    if frame == "local":
        cols = F.col("xl"), F.col("yl"), F.col("zl")
    elif frame == "trans":
        cols = F.col("xt"), F.col("yt"), F.round(F.col("zt") / pitch) * pitch
    else:
        at = lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(i) + 1)
        cols = tuple(at(v, i) for v, i in zip(x_values, ("ix", "iy", "iz"), strict=True))
    return df.withColumns(dict(zip(("u", "v", "w"), cols, strict=True)))


def d_slice(c: Column, edges=D_EDGES) -> Column:
    """0, 1, ... by upper edges, one more beyond the last; -1 where undefined."""
    out = F.when(c.isNull(), -1)
    for i, e in enumerate(edges):
        out = out.when(c <= e, i)
    return out.otherwise(len(edges))


def p_window(c: Column, centres=(2.0, 5.0, 10.0), half: float = 0.5) -> Column:
    """Index of the half-open window around a centre; -2 outside all."""
    out = F.when(c.isNull(), -2)
    for i, m in enumerate(centres):
        out = out.when((c >= m - half) & (c < m + half), i)
    return out.otherwise(-2)


def p_bin(df: DataFrame) -> DataFrame:
    """The producer's integer momentum bins with a label: 'k-k+1', or the true range where a momentum leaves it."""
    by = df.groupBy("bin").agg(F.count("*").alias("n"), F.min("p").alias("p_min"), F.max("p").alias("p_max"))
    inside = (F.col("p_min") >= F.col("bin")) & (F.col("p_max") < F.col("bin") + 1)
    return by.withColumn("label", F.when(inside, F.concat_ws("-", F.col("bin"), F.col("bin") + 1)).otherwise(F.concat_ws("..", F.round("p_min", 2), F.round("p_max", 2))))


def binary_label(df: DataFrame, stored: str | None = None) -> DataFrame:
    """Label of p >= 2; a stored label wins. Counts by label, with the disagreements."""
    own = F.when(F.col("p") >= 2, 1).otherwise(0)
    label = F.coalesce(F.col(stored), own) if stored else own
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.count_if(label != own).alias("disagree"))


def group_key(c: Column, n_events: int | None = None, groups: int = N_GROUPS) -> Column:
    """Jackknife group: the event itself for up to 64 events, else its number modulo 64."""
    return c if n_events is not None and n_events <= groups else F.pmod(c, F.lit(groups))


def measures() -> dict[str, Column]:
    """Per-hit summands of the channels."""
    e, s = F.col("energy"), F.col("shapcam")
    return {
        "m_e": e, "m_n": F.lit(1), "m_true": e * F.col("seg_true"), "m_pred": e * F.col("seg_pred"), "m_eg": e * F.col("gradcam"), "m_g": F.col("gradcam"),
        "m_es_pos": e * F.greatest(s, F.lit(0.0)), "m_es_neg": e * F.least(s, F.lit(0.0)), "m_s": s,
    }


def summed(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in measures().items()])


def channel(df: DataFrame) -> DataFrame:
    """Channels from summed measures: density, attention means by energy and by count, signed map energy."""
    return df.withColumns({
        "density": F.col("m_e"), "attention_energy": F.try_divide("m_eg", "m_e"), "attention_count": F.try_divide("m_g", "m_n"), "signed": F.col("m_es_pos") + F.col("m_es_neg"),
    })


def quantize(c: Column, low: float, high: float, levels: int = 255) -> Column:
    """8-bit code of log10 between two decades: 0 empty, 1 under the floor, then up to `levels`."""
    return F.when(c.isNull() | (c <= 0), 0).when(F.log10(c) < low, 1).otherwise(F.least(F.lit(levels), 2 + F.floor((F.log10(c) - low) / (high - low) * (levels - 2))))


def quantise_xy(df: DataFrame, size: float = 20.0, half: int = 25, n_z: int = 8) -> DataFrame:
    """Display bins of the translated frame; -1 outside, depth clipped."""
    at = lambda c: F.floor(F.col(c) / size) + half
    inside = lambda c: F.when((at(c) >= 0) & (at(c) < 2 * half), at(c)).otherwise(-1)
    return df.withColumns({"jx": inside("xt"), "jy": inside("yt"), "jz": F.least(F.lit(n_z - 1), F.greatest(F.lit(0), F.floor(F.col("zt") / PITCH)))})


def project_rows(df: DataFrame) -> DataFrame:
    """Projection rows: ordinals, origin code, own layer and energy shares of each kept hit."""
    code = F.when(F.col("origin") == "A", 1).when(F.col("origin") == "B", 2).otherwise(3)
    layer = F.round(F.col("zt") / PITCH).cast("int")
    return df.select("event_number", "cell_id", "ix", "iy", "iz", code.alias("org"), layer.alias("kt"), "energy", "xt", "yt", "xl", "yl", "zl", "seg_pred", "seg_true", "gradcam", "shapcam")
