"""Kernels that spread what a bin holds over other bins, by integrals between their edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond so many deviations a Gaussian is left out (2e-19 of it).
REACH = 9.0
TERMS = 160


def erf(x: Column) -> Column:
    """The error function, by its series of terms of one sign, which 160 terms settle to a double's last digits up to |x| = 6.5."""
    square = x * x
    first = x * F.exp(-square) * (2 / math.sqrt(math.pi))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * square / (k + 0.5)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda acc: acc["sum"])
    return F.when(F.abs(x) > 6.4, F.signum(x)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), series)))


def _ramp(u: Column) -> Column:
    """The integral of the normal distribution function up to u."""
    return u * (1 + erf(u / math.sqrt(2))) / 2 + F.exp(-u * u / 2) / math.sqrt(2 * math.pi)


def gaussian(sigma: float):
    """Of an evenly filled source (lo, hi) under a Gaussian, the share below a place. A source without width is a point."""

    def below(at: Column) -> Column:
        a, b, width = (at - F.col("lo")) / sigma, (at - F.col("hi")) / sigma, F.col("hi") - F.col("lo")
        return F.when(width > 0, (_ramp(a) - _ramp(b)) * sigma / width).otherwise((1 + erf(a / math.sqrt(2))) / 2)

    return below, F.lit(REACH * sigma)


def tent():
    """Of a source (lo, hi) as a tent about its middle that falls to nothing one width away, the share below a place. Tents of
    even sources are linear interpolation between their middles. A source without width is a point."""
    width = F.col("hi") - F.col("lo")

    def below(at: Column) -> Column:
        u = (at - (F.col("lo") + F.col("hi")) / 2) / F.nullif(width, F.lit(0.0))
        side = F.when(u <= 0, (1 + u) * (1 + u) / 2).otherwise(1 - (1 - u) * (1 - u) / 2)
        return F.when(width > 0, F.when(u <= -1, 0.0).when(u >= 1, 1.0).otherwise(side)).otherwise((at > F.col("lo")).cast("double"))

    return below, width


def spread(cells: DataFrame, edges: list[float], kernel) -> DataFrame:
    """Values of sources (lo, hi, v) on the bins between `edges`, both of any widths. Bins -1 and len(edges) - 1 take what falls
    below and above, so the sum stays: a source's shares are differences of one rising function from 0 to 1. Only bins in the
    kernel's reach are looked at. Rows without bounds or value take no part."""
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges must rise")
    below, reach = kernel
    table = F.array(*[F.lit(float(e)) for e in edges])
    known = cells.filter("lo IS NOT NULL AND hi IS NOT NULL AND v IS NOT NULL AND hi >= lo")
    near = known.withColumns({"_first": F.size(F.filter(table, lambda e: e <= F.col("lo") - reach)) - 1, "_last": F.size(F.filter(table, lambda e: e < F.col("hi") + reach)) - 1})
    each = near.withColumn("bin", F.explode(F.sequence("_first", F.greatest("_first", "_last"))))
    low = F.when(F.col("bin") > F.col("_first"), below(F.get(table, F.col("bin")))).otherwise(0.0)
    high = F.when(F.col("bin") < F.col("_last"), below(F.get(table, F.col("bin") + 1))).otherwise(1.0)
    return each.select("bin", (F.col("v") * F.greatest(F.lit(0.0), high - low)).alias("part")).groupBy("bin").agg(F.sum("part").alias("v"))
