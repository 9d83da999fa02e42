"""Exact quantiles by distributed selection, however many values a key has.

A key's values are counted in bins between their least and greatest one; only the bin that holds a sought rank is looked
at again, between the least and greatest value that it really holds, until those two are the same value. A round is one
aggregate with a partial sum before its shuffle, so no task holds more of a key than its bins; outliers and repeated values
cost no more. Keys of up to `small` values are settled by Spark's own percentile, which holds their distinct values.

Values that are null, NaN or infinite don't count. Keys may be null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

SMALL = 10_000
BINS = 65_536


def keyed(df: DataFrame, keys: Sequence[str], columns: Sequence[Column], weight: Column | None = None) -> DataFrame:
    """A row for each value of each column: _k (the key), _w (its weight, an integer), _q (the column's place), _v."""
    k = F.struct(*[F.col(x) for x in keys]) if keys else F.struct(F.lit(0).alias("_"))
    values = F.array(*[F.struct(F.lit(i).alias("_q"), c.cast("double").alias("_v")) for i, c in enumerate(columns)])
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    return df.select(k.alias("_k"), w.alias("_w"), F.inline(values)).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")) & (F.col("_w") > 0))


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_k", "_q").agg(F.sum("_w").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def selected(rows: DataFrame, targets: DataFrame, bins: int = BINS) -> DataFrame:
    """The value of each target (_k, _q, _t, rank from 0, and lo, hi and n of its values): the range [lo, hi] closes in on the rank until it is one value.
    A range of no more values than `bins` gets a bin for each value, and so is settled.

    A key's ranges are disjoint, so a row is in one of them at most; after the first round only rows of ranges that are
    still open are kept, in a table of their own. A rank finds its bin by a sort of ranks and bins together."""
    on = ["_k", "_q", "lo", "hi", "n"]
    state = written(targets.select(*on, "_t", "rank"), "quantile-ranks")
    closed, inside = state.filter("lo >= hi"), rows
    ranges = state.filter("lo < hi").select(*on).distinct()
    inside = rows.join(ranges, ["_k", "_q"])
    while not (open_ := state.filter("lo < hi")).isEmpty():
        half = lambda c: F.col(c) / 2  # noqa: E731  the width of a range may be beyond a double's reach
        share = F.when(F.col("hi") - F.col("lo") < float("inf"), (F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise((half("_v") - half("lo")) / (half("hi") - half("lo")))
        binned = inside.withColumn("bin", F.when(F.col("n") <= bins, F.col("_v")).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1))).cast("double"))
        counts = binned.groupBy(*on, "bin").agg(F.sum("_w").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*on).orderBy("bin"))
        bounds = counts.withColumn("at", upto - F.col("c")).select(*on, "at", F.lit(None).cast(open_.schema["_t"].dataType).alias("_t"), F.struct("bin", "at", "c", "least", "most").alias("here"))
        ranks = open_.select(*on, F.col("rank").alias("at"), "_t", F.lit(None).cast(bounds.schema["here"].dataType).alias("here"))
        before = F.last("here", ignorenulls=True).over(Window.partitionBy(*on).orderBy("at", F.col("here").isNull()).rowsBetween(Window.unboundedPreceding, 0))
        met = bounds.unionByName(ranks).withColumn("in", before).filter(F.col("here").isNull())
        state = written(met.select("_k", "_q", F.col("in.least").alias("lo"), F.col("in.most").alias("hi"), F.col("in.c").alias("n"), "_t", (F.col("at") - F.col("in.at")).alias("rank"), F.struct("lo", "hi", "n", F.col("in.bin").alias("bin")).alias("of")), "quantile-ranks")
        closed = closed.unionByName(state.filter("lo >= hi").select(*on, "_t", "rank"))
        next_ = state.filter("lo < hi").select("_k", "_q", "of.bin", F.col("of.lo").alias("of_lo"), F.col("of.hi").alias("of_hi"), F.col("of.n").alias("of_n"), F.col("lo").alias("to_lo"), F.col("hi").alias("to_hi"), F.col("n").alias("to_n")).distinct()
        if not next_.isEmpty():
            kept = binned.withColumnsRenamed({"lo": "of_lo", "hi": "of_hi", "n": "of_n"}).join(next_, ["_k", "_q", "of_lo", "of_hi", "of_n", "bin"])
            inside = written(kept.select("_k", "_w", "_q", "_v", F.col("to_lo").alias("lo"), F.col("to_hi").alias("hi"), F.col("to_n").alias("n")), "quantile-rows")
    return closed.select("_k", "_q", "_t", F.col("lo").alias("value"))


def quantiles(df: DataFrame, keys: Sequence[str], wants: Mapping[str, tuple[Column, Sequence[float]]], weight: Column | None = None, small: int = SMALL, bins: int = BINS) -> DataFrame:
    """For each key that has a value, and each name of `wants`, the array of its column's quantiles, interpolated between
    neighbouring ranks as percentile does. With a weight, a row counts as that many."""
    names, probs = list(wants), sorted({p for _, ps in wants.values() for p in ps})
    rows = keyed(df, keys, [c for c, _ in wants.values()], weight)
    by = written(sizes(rows), "quantile-sizes")
    n_small, n_large = by.agg(F.count_if(F.col("n") <= small), F.count_if(F.col("n") > small)).first()
    found = []
    if n_small or not n_large:
        some = rows.join(by.filter(F.col("n") <= small).select("_k", "_q"), ["_k", "_q"], "left_semi") if n_large else rows
        found.append(some.groupBy("_k", "_q").agg(F.percentile("_v", probs, F.col("_w")).alias("found")))
    if n_large:
        place = lambda p: (F.col("n") - 1) * F.lit(float(p))
        targets = F.array(*[F.struct(F.lit(2 * i + up).alias("_t"), (F.ceil if up else F.floor)(place(p)).alias("rank")) for i, p in enumerate(probs) for up in (0, 1)])
        large = by.filter(F.col("n") > small)
        values = selected(rows, large.select("_k", "_q", "lo", "hi", "n", F.inline(targets)), bins)
        pick = lambda t: F.max(F.when(F.col("_t") == t, F.col("value"))).alias(f"t{t}")
        ends = values.groupBy("_k", "_q").agg(*[pick(t) for t in range(2 * len(probs))]).join(large.select("_k", "_q", "n"), ["_k", "_q"])
        # From the lower value on, so that equal neighbours give just that value; a gap beyond a double's reach is weighed instead.
        share = lambda p: place(p) - F.floor(place(p))
        gap = lambda i: F.col(f"t{2 * i + 1}") - F.col(f"t{2 * i}")
        part = lambda i, p: F.when(gap(i) < float("inf"), F.col(f"t{2 * i}") + gap(i) * share(p)).otherwise(F.col(f"t{2 * i}") * (1 - share(p)) + F.col(f"t{2 * i + 1}") * share(p))
        found.append(ends.select("_k", "_q", F.array(*[part(i, p) for i, p in enumerate(probs)]).alias("found")))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    one = both.groupBy("_k").agg(*[F.max(F.when(F.col("_q") == i, F.col("found"))).alias(f"_{i}") for i in range(len(names))])
    chosen = [F.when(F.col(f"_{i}").isNotNull(), F.array(*[F.get(f"_{i}", F.lit(probs.index(p))) for p in ps])).alias(n) for i, (n, (_, ps)) in enumerate(wants.items())]
    return one.select(*[F.col("_k")[k].alias(k) for k in keys], *chosen)


def with_quantiles(by: DataFrame, df: DataFrame, keys: Sequence[str], wants: Mapping[str, tuple[Column | str, float | Sequence[float]]], weight: Column | None = None, small: int | None = None) -> DataFrame:
    """`by` (one row for each key) with the quantiles of df's columns beside it: a number for one probability, an array for several."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    many = {n: (col(c), list(ps) if isinstance(ps, (list, tuple)) else [ps]) for n, (c, ps) in wants.items()}
    found = quantiles(df, keys, many, weight, SMALL if small is None else small)
    found = found.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[F.col(n) if isinstance(wants[n][1], (list, tuple)) else F.get(n, F.lit(0)).alias(n) for n in wants])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return by.join(found, on, "left").drop(*[f"_on_{k}" for k in keys])
