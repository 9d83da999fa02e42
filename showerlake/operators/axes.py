"""Axes that all classes of a feature share: scale, ends on ticks, bins by the smallest class, edges between the values of a lattice."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import with_quantiles
from .events import EPS
from .filters import finite
from .panels import rice_bins

#: Fewest values that a class needs to be drawn, and to set a range; fewest and most bins; ticks aimed at.
DRAWN, BINS, TICKS = 15, (8, 120), 6
STEP_TOLERANCE, LEAST_STEP = 1e-3, 1.0


def nice_range(lo: Column, hi: Column, ticks: int = TICKS) -> tuple[Column, Column, Column]:
    """A range widened to ticks, and their interval: the smallest of 1, 2 or 5 times a power of ten that gives at most twice
    the ticks aimed at. An end that is on a tick stays. From 0 to 1 by 0.2 where the range is empty or unknown."""
    span, most = hi - lo, 2.0 * ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(span / most)))
    fits = lambda m: span / (m * power) <= most * (1 + 1e-12)
    step = F.when(fits(1.0), power).when(fits(2.0), 2 * power).when(fits(5.0), 5 * power).otherwise(10 * power)
    slack = lambda t: 1e-9 * F.greatest(F.lit(1.0), F.abs(t))
    low, high = F.floor(lo / step + slack(lo / step)) * step, F.ceil(hi / step - slack(hi / step)) * step
    known = lambda x, other: F.when(hi > lo, x).otherwise(F.lit(other))
    return known(low, 0.0), known(F.greatest(high, low + step), 1.0), known(step, 0.2)


def lattice_steps(values: DataFrame, fixed: Mapping[str, float | None]) -> DataFrame:
    """The step on which each named feature's values sit, one of them (anchor), and whether all do (verified).

    A step that is not given is the greatest common divisor of the gaps, by Euclid's rounds over all values at once: the least
    remainder becomes the next step, at most half the last, until none is left. Under a millimetre there is no step, and
    the feature no row. `fixed` bounds what the driver sees: three numbers for each of its names."""
    v = values.filter(F.col("feature").isin(*fixed)).select("feature", F.round("value", 6).alias("v")).distinct()
    anchors = {r["feature"]: r["a"] for r in v.groupBy("feature").agg(F.min("v").alias("a")).collect()}
    steps = {f: fixed[f] for f in anchors if fixed[f]}
    of = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("feature")]
    open_ = {f: float("inf") for f in anchors if not fixed[f]}
    while open_:
        gap = F.col("v") - of(anchors)
        rest = F.when(of(open_) < float("inf"), F.least(F.pmod(gap, of(open_)), of(open_) - F.pmod(gap, of(open_)))).otherwise(gap)
        left = {r["feature"]: r["r"] for r in v.filter(F.col("feature").isin(*open_)).groupBy("feature").agg(F.min(F.when(rest > STEP_TOLERANCE, rest)).alias("r")).collect()}
        steps |= {f: s for f, s in open_.items() if left[f] is None and LEAST_STEP <= s < float("inf")}
        open_ = {f: left[f] for f in open_ if left[f] is not None and left[f] >= LEAST_STEP}
    if not steps:
        return v.sparkSession.createDataFrame([], "feature string, step double, anchor double, verified int")
    at = (F.col("v") - of(anchors)) / of(steps)
    by = v.filter(F.col("feature").isin(*steps)).groupBy("feature").agg((F.max(F.abs(at - F.round(at))) <= STEP_TOLERANCE).cast("int").alias("verified"))
    return by.select("feature", of(steps).alias("step"), of(anchors).alias("anchor"), "verified")


def plan_axes(rows: DataFrame, lattices: Mapping[str, float | None] | None = None, signed: tuple[str, ...] = ()) -> DataFrame:
    """One axis for each feature of rows (feature, label, value): scale, lo, width, bins, interval of ticks, decades spanned, step and
    steps a bin, and whether it is provisional.

    Classes of 15 values and more set the range, all do where none has as many (then it is provisional); values at the floor
    of lengths don't, unless there are no others. The range is from the 1st to the 99th percentile, widened to ticks. A
    feature that is neither signed nor on a lattice and spans a decade there has a log axis: lo, width and interval are of log10 of the value.
    Bins follow Rice's rule for the smallest class drawn. Bins on a lattice are whole steps wide, with edges half a step off
    its values. `lattices` maps features to steps, None for one that is to be measured. Values that are null, NaN or
    infinite take no part."""
    lattices = lattices or {}
    named, either = F.col("feature").isin(*lattices), F.col("feature").isin(*signed)
    rows = rows.filter(finite(F.col("value")))
    measured = either | (F.col("value") > EPS)
    sizes = rows.groupBy("feature", "label").agg(F.count("*").alias("n"), F.count_if(measured).alias("m"))
    by = sizes.groupBy("feature").agg(F.coalesce(F.min(F.when(F.col("n") >= DRAWN, F.col("n"))), F.lit(0)).alias("least"))
    facts = sizes.join(by, "feature").filter((F.col("n") >= DRAWN) | (F.col("least") == 0))
    some = facts.groupBy("feature").agg(F.sum("m").alias("known"))
    setting = facts.join(some, "feature").select("feature", F.col("label").alias("of"), "known")
    ranged = rows.join(setting, (rows["feature"] == setting["feature"]) & rows["label"].eqNullSafe(F.col("of"))).drop(setting["feature"]).filter(measured | (F.col("known") == 0))
    found = with_quantiles(by, ranged, ["feature"], {"p": ("value", [0.01, 0.99]), "g": (F.when(F.col("value") > 0, F.log10("value")), [0.01, 0.99])})
    p, g = [F.get("p", F.lit(i)) for i in (0, 1)], [F.get("g", F.lit(i)) for i in (0, 1)]
    decades = F.when(~either & (p[0] > 0), F.log10(p[1] / p[0]))
    plan = found.withColumn("decades", decades).withColumn("log", ~named & F.coalesce(F.col("decades") >= 1, F.lit(False)))
    lo, hi, step = nice_range(*[F.when(F.col("log"), g[i]).otherwise(p[i]) for i in (0, 1)])
    plan = plan.withColumns({"lo": lo, "hi": hi, "interval": step, "bins": F.greatest(F.lit(BINS[0]), F.least(F.lit(BINS[1]), rice_bins(F.col("least"))))})
    if lattices:
        plan = plan.join(lattice_steps(rows.filter(F.col("value") > EPS), lattices), "feature", "left")
    else:
        plan = plan.withColumns({"step": F.lit(None).cast("double"), "anchor": F.lit(None).cast("double"), "verified": F.lit(0)})
    snap, q = F.coalesce(F.col("verified") == 1, F.lit(False)), F.col("step")
    per = F.when(snap, F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / F.col("bins") / q - 1e-9)))
    first = F.when(snap, F.col("anchor") + (F.floor((F.col("lo") - F.col("anchor")) / q - 0.5 + 1e-9) + 0.5) * q).otherwise(F.col("lo"))
    plan = plan.withColumns({"steps": per, "first": first})
    width = F.when(snap, F.col("steps") * q).otherwise((F.col("hi") - F.col("lo")) / F.col("bins"))
    bins = F.when(snap, F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("first")) / (F.col("steps") * q) - 1e-9))).otherwise(F.col("bins"))
    return plan.select("feature", F.when(F.col("log"), "log").otherwise("linear").alias("scale"), F.col("first").alias("lo"), width.alias("width"), bins.cast("int").alias("bins"), "interval", "decades", "step", "steps", (F.col("least") == 0).cast("int").alias("provisional"))


def planned_hist(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Counts of each class on its feature's axis. Bin -1 is below it, bin `bins` above; the last one is closed. What has no
    place on a log axis, as it isn't positive, is in bin -2. Plans are a row for each feature."""
    x = F.when(F.col("scale") == "log", F.when(F.col("value") > 0, F.log10("value"))).otherwise(F.col("value"))
    on = rows.filter(finite(F.col("value"))).join(plan.select("feature", "scale", "lo", "width", "bins"), "feature").withColumn("x", x)
    end = F.col("lo") + F.col("bins") * F.col("width")
    at = F.when(F.col("x").isNull(), -2).when(F.col("x") < F.col("lo"), -1).when(F.col("x") > end, F.col("bins")).otherwise(F.least(F.col("bins") - 1, F.floor((F.col("x") - F.col("lo")) / F.col("width"))))
    return on.groupBy("feature", "label", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
