"""Detector hits over the test tables: a line item is a hit, its order is the event.

The text of each relation runs in Spark SQL and in the engine that checks the results, so both
sides start from the same rows. {lineitem} and {orders} stand for the tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import events as ev
from ..operators import filters as fl

BASE = """
SELECT CAST(l_orderkey AS BIGINT) AS event_number, CAST(l_partkey % 20 AS INT) AS ix, CAST(l_suppkey % 3 AS INT) AS iy, CAST(l_linenumber - 1 AS INT) AS iz,
  CAST(((l_linenumber - 1) * 3 + l_suppkey % 3) * 20 + l_partkey % 20 AS BIGINT) AS cell_id,
  CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'R' THEN 'B' WHEN l_linestatus = 'F' THEN 'A' ELSE 'A+B' END AS origin,
  CASE WHEN l_quantity = 50 THEN 0e0 ELSE CAST(l_extendedprice AS DOUBLE) / 1e6 END AS energy,
  5e-1 + CAST(o_totalprice AS DOUBLE) / 25641e0 AS p_a, 5e-1 + (o_custkey % 1950) / 1e2 AS p_b,
  2e-2 + (o_custkey % 60) / 1e2 AS theta_a, 2e-2 + (o_orderkey % 55) / 1e2 AS theta_b,
  (o_orderkey * 7 % 628) / 1e2 - 314e-2 AS phi_a, (o_custkey * 11 % 628) / 1e2 - 314e-2 AS phi_b,
  (o_orderkey % 11) * 1e1 AS q_ax, (o_orderkey % 7) * 1e1 AS q_ay, (o_custkey % 13) * 1e1 AS q_bx, (o_custkey % 5) * 1e1 AS q_by,
  CAST(l_discount AS DOUBLE) * 1e1 AS seg_pred, CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'F') THEN 1e0 ELSE CAST(l_tax AS DOUBLE) * 125e-1 END AS seg_true,
  CAST(l_discount AS DOUBLE) * 1e1 AS gradcam, CAST(l_tax AS DOUBLE) * 25e0 - 1e0 AS shapcam,
  9e-1 + (o_orderkey % 21) / 1e2 AS energy_scale, ((o_orderkey % 13) - 6) / 1e3 AS angle_shift, CAST(l_linenumber % 2 AS INT) AS is_secondary,
  CASE l_partkey % 6 WHEN 0 THEN 'e-' WHEN 1 THEN 'e+' WHEN 2 THEN 'gamma' WHEN 3 THEN 'pi-' WHEN 4 THEN 'proton' ELSE 'neutron' END AS particle_type,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 'gamma' END AS parent_type,
  CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'e-' WHEN 2 THEN 'e-;gamma' ELSE 'e-;gamma;e-' END AS daughter_type
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

PLACED = f"""
SELECT *, ix * 48e0 + (ix % 2) * 44e-1 AS x, iy * 505e-1 AS y, 36624e-1 + iz * 205e-1 AS z,
  CASE WHEN origin = 'A' THEN p_a ELSE p_b END AS p, CASE WHEN origin = 'A' THEN theta_a ELSE theta_b END AS theta, CASE WHEN origin = 'A' THEN phi_a ELSE phi_b END AS phi
FROM ({BASE}) placed_base"""

MOVED = f"""
SELECT *, CASE WHEN origin = 'A+B' THEN 0e0 WHEN origin = 'A' THEN x - q_ax ELSE x - q_bx END AS xt,
  CASE WHEN origin = 'A+B' THEN 0e0 WHEN origin = 'A' THEN y - q_ay ELSE y - q_by END AS yt,
  CASE WHEN origin = 'A+B' THEN 0e0 ELSE z - 36624e-1 END AS zt,
  CAST(floor(p_a) AS INT) AS bin_a, CAST(floor(p_b) AS INT) AS bin_b, p * energy_scale AS energy_pred, theta + angle_shift AS angle_pred
FROM ({PLACED}) moved_base"""

HITS = f"""
SELECT *, round(cos(theta) * cos(phi) * xt + cos(theta) * sin(phi) * yt - sin(theta) * zt, 9) + 0e0 AS xl, round(cos(phi) * yt - sin(phi) * xt, 9) + 0e0 AS yl,
  round(sin(theta) * cos(phi) * xt + sin(theta) * sin(phi) * yt + cos(theta) * zt, 9) + 0e0 AS zl
FROM ({MOVED}) hits_base"""

SINGLE = f"""
SELECT *, round(cos(theta) * cos(phi) * xt + cos(theta) * sin(phi) * yt - sin(theta) * zt, 9) + 0e0 AS xl, round(cos(phi) * yt - sin(phi) * xt, 9) + 0e0 AS yl,
  round(sin(theta) * cos(phi) * xt + sin(theta) * sin(phi) * yt + cos(theta) * zt, 9) + 0e0 AS zl, CASE WHEN is_secondary = 0 THEN NULL ELSE 'gamma' END AS parent_type
FROM (SELECT event_number, cell_id, min(ix) AS ix, min(iy) AS iy, min(iz) AS iz, min(x) AS x, min(y) AS y, min(z) AS z, min(x) - min(q_ax) AS xt, min(y) - min(q_ay) AS yt,
  min(z) - 36624e-1 AS zt, sum(energy) AS energy, min(p_a) AS p, min(bin_a) AS p_bin, min(theta_a) AS theta, min(phi_a) AS phi, min(is_secondary) AS is_secondary,
  min(particle_type) AS particle_type, min(daughter_type) AS daughter_type FROM ({MOVED}) single_base GROUP BY event_number, cell_id) single_cells"""


class Fixture:
    """The relations that the registered queries start from.

    Hits and the tables derived per event are kept for the session (in memory, or on executors' disks), as a
    dataset's derived tables would be: a panel is then a roll-up of them, and its plan starts there."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, lineitem=self.table("lineitem"), orders=self.table("orders"))

    @cached_property
    def source(self) -> DataFrame:
        """All hits as they come, for whoever reads them once: nothing is kept."""
        return self.sql(HITS)

    @cached_property
    def raw(self) -> DataFrame:
        """All hits, those without energy too."""
        return self.sql(HITS).persist()

    @cached_property
    def hits(self) -> DataFrame:
        return fl.keep_hits(self.raw)

    def some(self, *columns: str) -> DataFrame:
        """The named columns of `hits`, for whoever needs few: only they are kept for the session, with what the rule says of
        each hit, so that the plan of a filter doesn't repeat the coordinates' expressions."""
        return self.source.select(*columns, fl.hit_rule().alias("_kept")).persist().filter("_kept").drop("_kept")

    def by_event(self, *columns: str) -> DataFrame:
        """The named columns of `hits`, dealt by event once, so that sums and joins by event and more find them in place."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        kept = self.source.select("event_number", *columns, fl.hit_rule().alias("_kept"))
        return kept.repartition(parts, "event_number").persist().filter("_kept").drop("_kept")

    def some_events(self, hits: tuple[str, ...], events: tuple[str, ...]) -> DataFrame:
        """The named columns of `events`, from the named columns of the hits, for whoever needs few of both."""
        return ev.events_two(self.some("event_number", "origin", "energy", *hits), events).select("event_number", *events).persist()

    def series_showers(self) -> DataFrame:
        """What series of energies and their errors need of `showers`."""
        columns = ("p", "bin", "theta", "energy_pred", "e_own")
        events = ("e1", "e2", "e1_bin", "e2_bin", "d", *[f"{n}_{s}" for n in ("theta", "energy_pred", "e_own", "n_own") for s in "ab"])
        return fl.showers(self.some_events(("p_a", "p_b", "bin_a", "bin_b", "theta_a", "theta_b", "energy_pred", "x", "y", "z"), events), columns=columns)

    @cached_property
    def single_source(self) -> DataFrame:
        """One shower an event, one row a cell, for whoever reads it once."""
        return self.sql(SINGLE).filter("energy > 0")

    @cached_property
    def single(self) -> DataFrame:
        """One shower an event, one row a cell."""
        return self.sql(SINGLE).filter("energy > 0").persist()

    @cached_property
    def events(self) -> DataFrame:
        return ev.events_two(self.hits).persist()

    @cached_property
    def singles(self) -> DataFrame:
        return ev.events_single(self.single).persist()

    @cached_property
    def showers(self) -> DataFrame:
        return fl.showers(self.events)


_FIXTURES: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixture(spark, sf_dir)
    return _FIXTURES[key]
