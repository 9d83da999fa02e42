"""All queries of the library's own operators, with the SQL that each is held against.

A query is an operator on the fixture relations, and a list of its columns: `name` is an
integer, `~name` a real number (rounded to six digits on both sides), `$name` a text. The
SQL starts from the same base rows and says the rest in its own way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import HITS, SINGLE, Fixture, fixture

#: Energies are whole numbers of 1e-8; this keeps sums of them off the ties of rounding, on both sides.
OFF_TIES = 3712345678e-18
_TABLES = {"lineitem": "lineitem", "orders": "orders"}
AXES, FRAMES = "xyz", ("", "t", "l")


def _events_sql() -> str:
    own = {"a": "origin = 'A'", "b": "origin <> 'A'"}
    both = {"a": "origin <> 'B'", "b": "origin <> 'A'"}
    cols = []
    for s in "ab":
        cols += [f"avg({a} - {a}t) FILTER (WHERE {both[s]}) AS p0{s}{a}" for a in AXES]
        cols += [f"coalesce(sum(energy) FILTER (WHERE {own[s]}), 0e0) AS e_own_{s}", f"count(*) FILTER (WHERE {own[s]}) AS n_own_{s}"]
        cols += [f"sum(energy * {a}{f}) FILTER (WHERE {own[s]}) / sum(energy) FILTER (WHERE {own[s]}) AS c{s}{a}{f}" for f in FRAMES for a in AXES]
        cols += [f"max({c}) FILTER (WHERE {own[s]}) AS {c}_{s}" for c in ("energy_pred", "angle_pred")]
    gaps = [f"sqrt({' + '.join(f'(ca{a}{f} - cb{a}{f}) * (ca{a}{f} - cb{a}{f})' for a in AXES)}) AS {'d_' + f if f else 'd'}" for f in FRAMES]
    return f"""SELECT *, {', '.join(gaps)} FROM (SELECT event_number, max(p_a) AS e1, max(p_b) AS e2, max(bin_a) AS e1_bin, max(bin_b) AS e2_bin, max(theta_a) AS theta_a, max(theta_b) AS theta_b,
      max(phi_a) AS phi_a, max(phi_b) AS phi_b, count(*) AS n_hits, count(*) FILTER (WHERE origin = 'A') AS n_a, count(*) FILTER (WHERE origin = 'B') AS n_b, count(*) FILTER (WHERE origin = 'A+B') AS n_ab,
      sum(energy) AS e_dep, coalesce(sum(energy) FILTER (WHERE origin = 'A+B'), 0e0) AS e_ab, {', '.join(cols)},
      sum(energy * seg_pred) AS e_a_pred, sum(energy * (1 - seg_pred)) AS e_b_pred, sum(energy * seg_true) AS e_a_true, sum(energy * (1 - seg_true)) AS e_b_true, sum(abs(seg_pred - seg_true)) AS abs_err,
      sum(energy * abs(seg_pred - seg_true)) AS wabs_err, sum((seg_pred - seg_true) * (seg_pred - seg_true)) AS sq_err, count(*) FILTER (WHERE (seg_pred >= 5e-1) = (seg_true >= 5e-1)) AS n_correct,
      count(*) FILTER (WHERE seg_true >= 5e-1) AS n_true, count(*) FILTER (WHERE seg_pred >= 5e-1) AS n_pred, count(*) FILTER (WHERE seg_pred >= 5e-1 AND seg_true >= 5e-1) AS n_tp
      FROM hits GROUP BY event_number) e"""


def _showers_sql() -> str:
    def one(s: str, b: int, p: str) -> str:
        centres = ", ".join(f"c{s}{a}{f} AS c{a}{f}" for f in FRAMES for a in AXES)
        return f"""SELECT event_number, d, e1, e2, {b} AS b, {p} AS p, {p}_bin AS bin, theta_{s} AS theta, phi_{s} AS phi, e_own_{s} AS e_own, n_own_{s} AS n_own, p0{s}x AS p0x, p0{s}y AS p0y, p0{s}z AS p0z,
          {centres}, energy_pred_{s} AS energy_pred, angle_pred_{s} AS angle_pred FROM ev WHERE n_own_{s} > 0"""

    return f"{one('a', 0, 'e1')} UNION ALL {one('b', 1, 'e2')}"


def _singles_sql() -> str:
    centres = ", ".join(f"sum(energy * {a}{f}) / sum(energy) AS c{a}{f}" for f in FRAMES for a in AXES)
    return f"""SELECT event_number, max(p) AS p, max(p_bin) AS p_bin, max(theta) AS theta, max(phi) AS phi, count(*) AS n_hits, sum(energy) AS e_dep, avg(x - xt) AS p0x, avg(y - yt) AS p0y, avg(z - zt) AS p0z,
      count(*) FILTER (WHERE is_secondary = 0) AS n_primary, coalesce(sum(energy) FILTER (WHERE is_secondary = 0), 0e0) AS e_primary,
      count(*) FILTER (WHERE (is_secondary = 0) <> (parent_type IS NULL)) AS n_parent_mismatch,
      arg_max(particle_type, (energy, -cell_id)) FILTER (WHERE is_secondary = 0) AS primary_type, {centres} FROM single GROUP BY event_number"""


def _shapes_sql(source: str, keys: str) -> str:
    cols = ["count(*) AS n", "sum(energy) AS e", "count(*) FILTER (WHERE zl < -1025e-2) AS n_neg", "coalesce(sum(energy) FILTER (WHERE zl < -1025e-2), 0e0) AS e_neg", "sum(energy * sqrt(xl * xl + yl * yl)) AS e_rho", "sum(energy * (xl * xl + yl * yl)) AS e_rho2"]
    inner = []
    for f in FRAMES:
        r = f"sqrt(x{f} * x{f} + y{f} * y{f} + z{f} * z{f})"
        inner.append(f"{r} AS r_{f}, acos(greatest(-1e0, least(1e0, z{f} / CASE WHEN {r} = 0 THEN 1e-6 ELSE {r} END))) AS th_{f}, atan2(y{f}, x{f}) AS ph_{f}")
        cols += [f"min({a}{f}) AS min_{a}{f}, max({a}{f}) AS max_{a}{f}, sum(energy * {a}{f}) AS sum_e{a}{f}" for a in AXES]
        cols += [f"sum(r_{f}) AS sum_r_{f}, sum(r_{f} * r_{f}) AS sum_r2_{f}, stddev_samp(r_{f}) AS sd_r_{f}, max(r_{f}) AS max_r_{f}, sum(energy * r_{f}) AS sum_er_{f}, sum(th_{f}) AS sum_th_{f}, stddev_samp(th_{f}) AS sd_th_{f}, sum(ph_{f}) AS sum_ph_{f}, stddev_samp(ph_{f}) AS sd_ph_{f}, sum(cos(ph_{f})) AS sum_c_{f}, sum(sin(ph_{f})) AS sum_s_{f}"]
    return f"SELECT {keys}, {', '.join(cols)} FROM (SELECT *, {', '.join(inner)} FROM {source}) placed GROUP BY {keys}"


FEATURE_SQL = {
    "width": "greatest(max_xl - min_xl, 1e-6)", "height": "greatest(max_yl - min_yl, 1e-6)", "depth": "greatest(max_zl, 1e-6)", "depth_range": "greatest(max_zl - min_zl, 1e-6)",
    "centroid_x": "sum_exl / e", "centroid_y": "sum_eyl / e", "centroid_z": "sum_ezl / e", "mean_r": "CASE WHEN sum_r_l = 0 THEN 0 ELSE sum_r_l / n END", "std_r": "CASE WHEN sum_r_l = 0 THEN 0 ELSE sd_r_l END",
    "max_r": "CASE WHEN sum_r_l = 0 THEN 0 ELSE max_r_l END", "weighted_r": "sum_er_l / e", "avg_theta": "CASE WHEN sum_r_l = 0 THEN 0 ELSE sum_th_l / n END", "avg_phi": "CASE WHEN sum_r_l = 0 THEN 0 ELSE sum_ph_l / n END",
    "spread": "CASE WHEN sum_r_l = 0 THEN 0 ELSE sd_th_l + sd_ph_l END",
}

#: Relations that a query's SQL may name; those that it does name are put before it, in this order.
RELATIONS = {
    "raw": HITS.format(**_TABLES),
    "hits": "SELECT * FROM raw WHERE energy > 0",
    "single": f"SELECT * FROM ({SINGLE.format(**_TABLES)}) s0 WHERE energy > 0",
    "ev": _events_sql(),
    "sh": _showers_sql(),
    "sg": _singles_sql(),
    "shapes": _shapes_sql("single", "event_number"),
    "ft0": f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in FEATURE_SQL.items())} FROM shapes",
    "ft": "SELECT ft0.*, width * height * depth AS volume, sg.p, sg.p_bin, sg.theta, sg.phi, CASE WHEN sg.p >= 2 THEN 1 ELSE 0 END AS label FROM ft0 JOIN sg USING (event_number)",
    "lay": "SELECT event_number, CASE WHEN origin = 'A' THEN 0 ELSE 1 END AS b, CAST(round(zt / 205e-1) AS INT) AS layer, sum(energy) AS e, count(*) AS n, sum(energy * xt) AS e_u, sum(energy * yt) AS e_v, sum(energy * sqrt(xt * xt + yt * yt)) AS e_rho, sum(energy * (xt * xt + yt * yt)) AS e_rho2 FROM hits GROUP BY ALL",
    "cells": "SELECT ix, iy, iz, sum(energy) AS m_e, count(*) AS m_n, sum(energy * seg_true) AS m_true, sum(energy * seg_pred) AS m_pred, sum(energy * gradcam) AS m_eg, sum(gradcam) AS m_g, sum(energy * greatest(shapcam, 0)) AS m_es_pos, sum(energy * least(shapcam, 0)) AS m_es_neg, sum(shapcam) AS m_s FROM hits GROUP BY ALL",
    "fr": "SELECT event_number, d, n_hits, theta_a, theta_b, phi_a, phi_b, xa, ya, xb, yb, atan2(yb - ya, xb - xa) AS psi, (xa + xb) / 2 AS ax, (ya + yb) / 2 AS ay, sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) AS d_entry FROM (SELECT *, cax - (caz - 36624e-1) * tan(theta_a) * cos(phi_a) AS xa, cay - (caz - 36624e-1) * tan(theta_a) * sin(phi_a) AS ya, cbx - (cbz - 36624e-1) * tan(theta_b) * cos(phi_b) AS xb, cby - (cbz - 36624e-1) * tan(theta_b) * sin(phi_b) AS yb FROM ev WHERE d IS NOT NULL) q",
}


@dataclass(frozen=True)
class Query:
    build: Callable[[Fixture], DataFrame]
    columns: tuple[str, ...]
    sql: str | None

    def run(self, spark, sf_dir: str) -> DataFrame:
        df = self.build(fixture(spark, sf_dir))
        out = []
        for c in self.columns:
            name = c.lstrip("~$")
            col = F.col(name)
            out.append((F.round(col.cast("double") + F.lit(OFF_TIES), 6) + F.lit(0.0) if c[0] == "~" else col.cast("string") if c[0] == "$" else col.cast("long")).alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        import re

        needed: set[str] = set()
        text = self.sql
        for name in reversed(list(RELATIONS)):
            if re.search(rf"\b{name}\b", text + " ".join(RELATIONS[n] for n in needed)):
                needed.add(name)
        head = ", ".join(f"{n} AS MATERIALIZED ({RELATIONS[n]})" for n in RELATIONS if n in needed)
        cols = []
        for c in self.columns:
            name = c.lstrip("~$")
            cols.append(f'round(CAST("{name}" AS DOUBLE) + 3712345678e-18, 6) + CAST(0 AS DOUBLE) AS "{name}"' if c[0] == "~" else f'CAST("{name}" AS VARCHAR) AS "{name}"' if c[0] == "$" else f'CAST("{name}" AS BIGINT) AS "{name}"')
        body = f"SELECT {', '.join(cols)} FROM ({self.sql}) answer"
        return f"WITH {head} {body}" if head else body


REGISTERED: dict[str, Query] = {}


def q(name: str, build: Callable[[Fixture], DataFrame], columns: str, sql: str | None = None) -> None:
    if name in REGISTERED:
        raise ValueError(f"{name} is registered twice")
    REGISTERED[name] = Query(build, tuple(columns.split()), sql)


def _load() -> None:
    if not REGISTERED:
        from . import base, clusters, frames, panels, tables  # noqa: F401


def queries() -> dict:
    _load()
    return {name: query.run for name, query in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, query in REGISTERED.items() if (sql := query.oracle()) is not None}
