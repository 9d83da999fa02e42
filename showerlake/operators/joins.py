"""Joins of hits, showers, events and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import cell_census, events_two
from .filters import Z_FRONT, own_shower

MOST_LATTICE_VALUES = 10_000


def ordinal(df: DataFrame, column: str) -> DataFrame:
    """The sorted distinct values of a column with their dense number from 0."""
    values = df.select(column).distinct()
    return values.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias("k"))


def with_ordinals(hits: DataFrame) -> DataFrame:
    """Coordinates as their lattice numbers. A lattice of more than MOST_LATTICE_VALUES values is refused, so its side is small enough to broadcast."""
    for a in "xyz":
        values = ordinal(hits, a)
        if len(values.limit(MOST_LATTICE_VALUES + 1).select("k").collect()) > MOST_LATTICE_VALUES:
            raise ValueError(f"{a} is no lattice coordinate")
        hits = hits.join(F.broadcast(values.withColumnRenamed("k", f"k{a}")), a)
    return hits


def join_showers(hits: DataFrame, showers: DataFrame) -> DataFrame:
    """Each hit with its shower, and its share of the shower's energy."""
    h = hits.select("event_number", "cell_id", "energy", own_shower(F.col("origin")).alias("b"))
    return h.join(showers.select("event_number", "b", "e_own"), ["event_number", "b"]).withColumn("share", F.col("energy") / F.col("e_own"))


def entry(s: str, anchor: str = "backprojected", z_front: float = Z_FRONT) -> tuple[Column, Column]:
    """Where a shower enters the front face: its centroid (or first-layer point) moved back along its direction."""
    p = [f"c{s}{a}" if anchor == "backprojected" else f"p0{s}{a}" for a in "xyz"]
    drift = (F.col(p[2]) - z_front) * F.tan(f"theta_{s}")
    return F.col(p[0]) - drift * F.cos(f"phi_{s}"), F.col(p[1]) - drift * F.sin(f"phi_{s}")


def event_frame(events: DataFrame, anchor: str = "backprojected") -> DataFrame:
    """The D-frame of each event with both showers: its azimuth psi from A to B, its origin halfway, the entries and their distance."""
    (xa, ya), (xb, yb) = entry("a", anchor), entry("b", anchor)
    e = events.filter("d IS NOT NULL").withColumns({"xa": xa, "ya": ya, "xb": xb, "yb": yb})
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    return e.withColumns({"psi": F.atan2(dy, dx), "ax": (F.col("xa") + F.col("xb")) / 2, "ay": (F.col("ya") + F.col("yb")) / 2, "d_entry": F.sqrt(dx * dx + dy * dy)})


def turned(x: Column, y: Column) -> tuple[Column, Column]:
    """A laboratory point in the D-frame of its row."""
    dx, dy, c, s = x - F.col("ax"), y - F.col("ay"), F.cos("psi"), F.sin("psi")
    return c * dx + s * dy, c * dy - s * dx


def join_frame(hits: DataFrame, frame: DataFrame) -> DataFrame:
    """Hits of the events that have a frame, in it."""
    met = hits.join(frame.select("event_number", "psi", "ax", "ay"), "event_number")
    dx, dy = turned(F.col("x"), F.col("y"))
    return met.withColumns({"dx": dx, "dy": dy})


def event_table(hits: DataFrame) -> DataFrame:
    """The event aggregate with the cell census; events without a census have zeros."""
    census = cell_census(hits)
    return events_two(hits).join(census, "event_number", "left").fillna(0, ["n_cells", "n_split", "n_bad_split"])


def restrict(df: DataFrame, events: DataFrame) -> DataFrame:
    """Rows whose event is selected."""
    return df.join(events.select("event_number"), "event_number", "left_semi")


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("event_number"), "event_number", "left_anti")


def parity_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many events both have, and either alone."""
    sides = a.select("event_number", F.lit(1).alias("s")).unionByName(b.select("event_number", F.lit(2).alias("s"))).distinct()
    by = sides.groupBy("event_number").agg(F.sum("s").alias("s"))
    return by.agg(F.count_if(F.col("s") == 3).alias("shared"), F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Events whose two counts differ; a missing count differs from every number."""
    met = a.withColumnRenamed("n", "left_n").join(b.withColumnRenamed("n", "right_n"), "event_number", "left")
    return met.filter(~F.col("left_n").eqNullSafe(F.col("right_n")))


def first_layer(hits: DataFrame) -> DataFrame:
    """The rows of each shower at its own smallest z."""
    b = own_shower(F.col("origin"))
    w = Window.partitionBy("event_number", b)
    return hits.withColumns({"b": b, "z0": F.min("z").over(w)}).filter("z = z0")


def resample(cells: DataFrame, edges: list[float]) -> DataFrame:
    """Values of source intervals (lo, hi, v) on other bins, by the share of each that overlaps.

    The bins of a source are found from their even width, so the join is an explode."""
    start, width, n = edges[0], edges[1] - edges[0], len(edges) - 1
    first = F.greatest(F.lit(0), F.floor((F.col("lo") - start) / width)).cast("int")
    last = F.least(F.lit(n - 1), F.floor((F.col("hi") - start) / width)).cast("int")
    each = cells.filter((F.col("hi") > start) & (F.col("lo") < edges[-1])).withColumn("bin", F.explode(F.sequence(first, last)))
    lo, hi = F.col("bin") * width + start, (F.col("bin") + 1) * width + start
    part = (F.least("hi", hi) - F.greatest("lo", lo)) / (F.col("hi") - F.col("lo"))
    return each.withColumn("part", F.col("v") * part).filter("part > 0").groupBy("bin").agg(F.sum("part").alias("v"))


def counted_gate(events: DataFrame) -> DataFrame:
    """How many are selected, beside the aggregate of those that have a frame."""
    gate = F.col("d").isNotNull()
    return events.agg(F.count("*").alias("n_selected"), F.count_if(gate).alias("n_framed"), F.avg(F.when(gate, F.col("d"))).alias("mean_d"))
