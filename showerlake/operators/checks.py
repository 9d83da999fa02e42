"""Checks of archives and derived tables: each gives a residual or counts of what breaks a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import with_quantiles
from ..sources.shared import written
from . import events as ev
from .filters import PITCH, finite, own_shower


def check_rows(source: DataFrame, archive: DataFrame) -> DataFrame:
    n = source.agg(F.count("*").alias("source")).crossJoin(archive.agg(F.count("*").alias("archive")))
    return n.withColumn("failed", (F.col("source") != F.col("archive")).cast("int"))


def check_projection(archive: DataFrame, projection: DataFrame, most: float = 0.05) -> DataFrame:
    a = archive.agg(F.count("*").alias("rows"), F.countDistinct("event_number").alias("events"))
    p = projection.agg(F.count("*").alias("kept"), F.countDistinct("event_number").alias("kept_events"))
    out = a.crossJoin(p)
    return out.withColumns({"warned": (F.col("kept") < (1 - most) * F.col("rows")).cast("int"), "failed": (F.col("kept") > F.col("rows")).cast("int")})


def check_lattice(projection: DataFrame, sizes=(20, 3, 7)) -> DataFrame:
    out = projection.agg(*[F.max(c).alias(f"max_{c}") for c in ("ix", "iy", "iz")], F.least(F.min("ix"), F.min("iy"), F.min("iz")).alias("least"))
    bad = F.col("least") < 0
    for c, n in zip(("ix", "iy", "iz"), sizes, strict=True):
        bad |= F.col(f"max_{c}") >= n
    return out.withColumn("failed", bad.cast("int"))


def check_energy(df: DataFrame) -> DataFrame:
    out = df.agg(F.sum("energy").alias("energy"), F.count_if(~finite(F.col("energy"))).alias("not_finite"))
    return out.withColumn("failed", (~F.coalesce(F.col("energy") > 0, F.lit(False)) | (F.col("not_finite") > 0)).cast("int"))  # no rows: no energy


def check_derived(hits: DataFrame, events: DataFrame, layers: DataFrame) -> DataFrame:
    """Energies of showers and layers against the events': largest relative difference."""
    l = layers.groupBy("event_number").agg(F.sum("e").alias("le"), F.sum("n").alias("ln"))  # noqa: E741
    met = events.join(l, "event_number", "left")
    rel = lambda x: F.max(F.abs(x - F.col("e_dep")) / F.col("e_dep"))
    return met.agg(rel(F.col("e_own_a") + F.col("e_own_b")).alias("shower_residual"), rel(F.col("le")).alias("layer_residual"), F.count_if(~F.col("ln").eqNullSafe(F.col("n_hits"))).alias("failed"))


def check_partition(hits: DataFrame, events: DataFrame, layers: DataFrame, prof: DataFrame, most: float = 1e-9) -> DataFrame:
    """Whether derived tables divide each event and shower among them, in one row.

    Events whose showers' hits don't add up, and the largest relative difference of their energies; showers with a cell twice;
    showers whose layers have other hits, and the largest difference of energies; axes of profiles that are missing, and the
    largest differences of their energies and of those in front of the entry layer. `failed` counts the rules that are broken."""
    b = own_shower(F.col("origin"))
    neg = F.when(F.col("zl") < ev.NEGATIVE_DEPTH, F.col("energy")).otherwise(0.0)
    cells = hits.groupBy("event_number", b.alias("b"), "cell_id").agg(F.count("*").alias("n"), F.sum("energy").alias("e"), F.sum(neg).alias("e_neg"))
    s = cells.groupBy("event_number", "b").agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.sum("e").alias("e"), F.sum("e_neg").alias("e_neg"))
    l = layers.groupBy("event_number", "b").agg(F.sum("n").alias("ln"), F.sum("e").alias("le"))  # noqa: E741
    p = prof.groupBy("event_number", "b", "axis").agg(F.sum("e").alias("pe"), F.sum("e_neg").alias("pn"))
    p = s.select("event_number", "b", "e", "e_neg").join(p, ["event_number", "b"], "left").groupBy("event_number", "b").agg(
        F.count("axis").alias("axes"), F.max(F.abs(F.col("pe") - F.col("e"))).alias("pd"), F.max(F.abs(F.col("pn") - F.col("e_neg"))).alias("nd"),
    )
    met = s.join(l, ["event_number", "b"], "left").join(p, ["event_number", "b"], "left")
    worst = lambda x: F.max(F.try_divide(F.abs(x), F.col("e")))
    of_showers = met.agg(
        F.count_if(F.col("n") != F.col("cells")).alias("cells_twice"), F.count_if(~F.col("ln").eqNullSafe(F.col("n"))).alias("layers_off"), worst(F.col("le") - F.col("e")).alias("layer_residual"),
        F.coalesce(F.sum(2 - F.col("axes")), F.lit(0)).alias("axes_missing"), worst(F.col("pd")).alias("profile_residual"), worst(F.col("nd")).alias("negative_residual"),
    )
    rest = F.col("e_own_a") + F.col("e_own_b") - F.col("e_dep")
    of_events = events.agg(F.count_if(F.col("n_own_a") + F.col("n_own_b") != F.col("n_hits")).alias("hits_off"), F.max(F.try_divide(F.abs(rest), F.col("e_dep"))).alias("shower_residual"))
    far = [F.coalesce(F.col(c), F.lit(0.0)) > t for c, t in (("shower_residual", 1e-12), ("layer_residual", most), ("profile_residual", most), ("negative_residual", most))]
    off = [F.col(c) > 0 for c in ("hits_off", "layers_off", "axes_missing")]
    return of_events.crossJoin(of_showers).withColumn("failed", sum((x.cast("int") for x in (*off, *far)), F.lit(0)))


def check_undefined_d(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n"), F.count_if(F.col("d").isNull()).alias("undefined"), F.count_if(F.col("d").isNull() != ((F.col("n_own_a") == 0) | (F.col("n_own_b") == 0))).alias("failed"))


def check_rows_contract(hits: DataFrame) -> DataFrame:
    """Per row, in one pass: values that are not finite, residuals of rotation and layer, values out of range, A+B rows off
    the origin, unknown origins, and how far a row's momentum and angle are from those of its own shower."""
    c = F.col
    r = hits.withColumns(ev.rotation())
    turned = {"xl": c("r11") * c("xt") + c("r12") * c("yt") + c("r13") * c("zt"), "yl": c("r21") * c("xt") + c("r22") * c("yt"), "zl": c("r31") * c("xt") + c("r32") * c("yt") + c("r33") * c("zt")}
    rot = F.greatest(*[F.abs(c(k) - v) for k, v in turned.items()])
    layer = F.abs(c("zt") / PITCH - F.round(c("zt") / PITCH))
    own = lambda x: F.max(F.when(c("origin") != "A+B", F.abs(c(x) - F.when(c("origin") == "A", c(f"{x}_a")).otherwise(c(f"{x}_b")))))
    placed = [f"{a}{f}" for f in ("", "t", "l") for a in "xyz"]
    return r.agg(
        F.count_if(~finite(c("xl"))).alias("not_finite"), F.sum(sum(((~finite(c(k))).cast("int") for k in placed), F.lit(0))).alias("not_finite_all"), F.max(rot).alias("rotation"), F.max(layer).alias("layer"),
        F.count_if(~c("seg_pred").between(0, 1)).alias("out_of_range"), F.count_if(~c("seg_true").between(0, 1)).alias("true_out_of_range"),
        F.count_if(~c("gradcam").between(0, 1)).alias("gradcam_outside"), F.count_if(F.abs("shapcam") > 1).alias("shapcam_outside"),
        F.count_if((c("origin") == "A+B") & ((c("xt") != 0) | (c("yt") != 0) | (c("zt") != 0))).alias("off_origin"), F.count_if(~F.coalesce(c("origin").isin("A", "B", "A+B"), F.lit(False))).alias("bad_origin"),
        own("p").alias("p_residual"), own("theta").alias("theta_residual"),
    )


def check_p0(hits: DataFrame) -> DataFrame:
    """Distance of each shower's entry point from the energy centroid of its first layer."""
    b = own_shower(F.col("origin"))
    w = Window.partitionBy("event_number", b)
    h = hits.withColumns({"b": b, "z0": F.min("z").over(w)})
    first = F.when(F.col("z") == F.col("z0"), F.col("energy"))
    by = h.groupBy("event_number", "b").agg(*[(F.sum(first * F.col(a)) / F.sum(first) - F.avg(F.col(a) - F.col(f"{a}t"))).alias(f"d{a}") for a in "xy"])
    d = F.hypot("dx", "dy")
    return by.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.max(d).alias("worst"))


def anchor_residual(frame: DataFrame, over: float = 50.5) -> DataFrame:
    """Distance between the two definitions of the entry, per shower."""
    from .joins import entry

    rows = []
    for s in "ab":
        (cx, cy), (px, py) = entry(s), entry(s, "p0")
        rows.append(F.struct(F.lit(s).alias("shower"), F.hypot(cx - px, cy - py).alias("r")))
    each = frame.select(F.inline(F.array(*rows)))
    return with_quantiles(each.groupBy("shower").agg(F.count_if(F.col("r") > over).alias("over")), each, ["shower"], {"median": ("r", 0.5), "p90": ("r", 0.9)})


def check_single(hits: DataFrame) -> DataFrame:
    cells = hits.groupBy("event_number", "cell_id").agg(F.count("*").alias("n"), F.max((F.col("p_bin") != F.floor("p")).cast("int")).alias("off"), F.count_if(F.col("particle_type").isNull()).alias("unknown"), F.count_if((F.col("is_secondary") == 0) != F.col("parent_type").isNull()).alias("parents"))
    return cells.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.sum("off").alias("off_bin"), F.sum("unknown").alias("unknown"), F.sum("parents").alias("parents"))


def check_events(features: DataFrame) -> DataFrame:
    return features.agg(F.count("*").alias("n"), F.count_if((F.col("p") >= 2).cast("int") != F.col("label")).alias("label_off"), F.count_if(F.col("width") <= 1e-6).alias("floored"), F.count_if(~F.col("avg_theta").between(0, 3.1415927)).alias("out_of_range"))


def feature_parity(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """Largest relative difference of each feature over the shared events, and the event of the worst (the smallest, at a tie).

    A difference is taken against the larger of both values and of the feature's median size in `b`, so that values near
    zero don't count as far apart. A value that one side alone has is an infinite difference; one that both lack is none."""
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"a.{n}").cast("double").alias("u"), F.col(f"b.{n}").cast("double").alias("v")) for n in names])
    # Written once: the search for medians reads it again and again.
    met = written(a.alias("a").join(b.alias("b"), "event_number").select("event_number", F.inline(rows)), "parity")
    u, v = F.when(finite(F.col("u")), F.col("u")), F.when(finite(F.col("v")), F.col("v"))
    both = u.isNotNull() & v.isNotNull()
    size = F.abs(F.when(both, F.col("v")))
    floors = with_quantiles(met.select("feature").distinct(), met, ["feature"], {"floor": (size, 0.5)})
    scale = F.greatest(F.abs(u), F.abs(v), F.coalesce("floor", F.lit(0.0)))
    rel = F.when(both, F.coalesce(F.try_divide(F.abs(u - v), scale), F.lit(0.0))).when(u.isNull() & v.isNull(), 0.0).otherwise(float("inf"))
    each = met.join(floors, "feature").withColumn("rel", F.round(rel, 9))
    return each.groupBy("feature").agg(F.max("rel").alias("rel"), F.max_by("event_number", F.struct("rel", -F.col("event_number"))).alias("worst"), F.count("*").alias("n"), F.first("floor").alias("floor"))


def check_sums(events: DataFrame, sums: DataFrame, total: str, most: float = 1e-6) -> DataFrame:
    """Events whose sums are missing, or do not add up to `total` (of `events`, by event and shower where it has one)."""
    keys = ["event_number", *(["b"] if "b" in events.columns else [])]
    by = sums.groupBy(*keys).agg(F.sum("e").alias("_e"))
    met = events.select(*keys, F.col(total).alias("_total")).join(by, keys, "left")
    return met.agg(F.count_if(~F.coalesce(F.abs(F.col("_e") - F.col("_total")) <= most * F.abs("_total"), F.lit(False))).alias("failed"))


def failures(archive: DataFrame, tables: dict[str, DataFrame], kind: str = "two") -> DataFrame:
    """One row for each check of an ingest of this kind."""
    named = lambda n, df: df.select(F.lit(n).alias("check"), F.col("failed").cast("long"))
    added = lambda df, *names: df.withColumn("failed", sum((F.coalesce(F.col(n), F.lit(0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0))))
    events = tables["events"]
    if kind == "features":
        repeated = events.agg((F.count("*") - F.countDistinct("event_number")).alias("failed"))
        all_ = [named("rows", added(check_rows(archive, events), "failed")), named("repeated", repeated), named("labels", added(check_events(events.withColumns({"width": F.col("local_width"), "avg_theta": F.col("local_avg_theta")})), "label_off", "out_of_range"))]
    else:
        kept = tables["projection"]
        along = tables["profiles"].filter("axis = 0")
        all_ = [named("projection", check_projection(archive, kept)), named("lattice", check_lattice(kept)), named("energy", check_energy(kept))]
        if kind == "two":
            all_ += [named("derived", check_derived(archive, events, tables["layers"])), named("undefined_d", check_undefined_d(events))]
        else:
            all_ += [named("rows_of_cells", added(check_single(kept), "repeated", "off_bin", "unknown", "parents"))]
        all_ += [named("shape_sums", check_sums(events, tables["shape_sums"], "e_dep")), named("profiles", check_sums(events, along, "e_dep"))]
    out = all_[0]
    for df in all_[1:]:
        out = out.unionByName(df)
    return out
