"""Queries of geometry, frames and projections."""

from pyspark.sql import functions as F

from ..functions import kernels as kn
from ..operators import filters as fl
from ..operators import frames as fr
from ..operators import joins as jn
from .registry import q

MARGINAL = "SELECT CAST(floor(xl / 20) AS INT) AS bin, sum(energy) AS e FROM hits GROUP BY 1"


def marginal(c):
    return c.hits.groupBy(F.floor(F.col("xl") / 20).cast("int").alias("bin")).agg(F.sum("energy").alias("e"))


q("G1_lattice", lambda c: fr.lattice(c.hits), "$axis n ~lo ~hi ~min_gap ~max_gap uniform", "SELECT axis, count(*) AS n, min(v) AS lo, max(v) AS hi, min(gap) AS min_gap, max(gap) AS max_gap, CASE WHEN max(gap) - min(gap) < 1e-6 THEN 1 ELSE 0 END AS uniform FROM (SELECT axis, v, v - lag(v) OVER (PARTITION BY axis ORDER BY v) AS gap FROM (SELECT 'x' AS axis, x AS v FROM hits UNION SELECT 'y', y FROM hits UNION SELECT 'z', z FROM hits)) GROUP BY axis")
q("G2_layer_pitch", lambda c: fr.layer_pitch(c.some("z")), "~pitch n_layers", "SELECT min(gap) AS pitch, count(*) AS n_layers FROM (SELECT z - lag(z) OVER (ORDER BY z) AS gap FROM (SELECT DISTINCT z FROM hits))")
GAPS = "SELECT axis, gap FROM (SELECT 'x' AS axis, x - lag(x) OVER (PARTITION BY iy ORDER BY x) AS gap FROM (SELECT DISTINCT ix, iy, x, y FROM hits) UNION ALL SELECT 'y', y - lag(y) OVER (PARTITION BY ix ORDER BY y) FROM (SELECT DISTINCT ix, iy, x, y FROM hits)) WHERE gap > 0"
q("G3_footprint", lambda c: fr.footprint(c.hits), "$axis ~pitch n", f"WITH g AS ({GAPS}) SELECT g.axis, median(gap) AS pitch, count(*) AS n FROM g JOIN (SELECT axis, quantile_cont(gap, 5e-2) AS low FROM g GROUP BY axis) l ON g.axis = l.axis AND gap BETWEEN 9e-1 * low AND 125e-2 * low GROUP BY g.axis")
q("G4_bounds", lambda c: fr.bounds(c.events), "~min_e1 ~max_e1 ~min_e2 ~max_e2 ~min_d ~max_d without_d overlap_classes", "SELECT min(e1) AS min_e1, max(e1) AS max_e1, min(e2) AS min_e2, max(e2) AS max_e2, min(d) AS min_d, max(d) AS max_d, count(*) - count(d) AS without_d, count(DISTINCT n_ab > 0) AS overlap_classes FROM ev")
q("G5_frame_bounds", lambda c: fr.frame_bounds(c.hits), "$axis ~lo ~hi q_low q_high", "SELECT axis, min(lo) AS lo, max(hi) AS hi, min(bin) FILTER (WHERE share >= 1e-2) AS q_low, min(bin) FILTER (WHERE share >= 99e-2) AS q_high FROM (SELECT *, sum(e) OVER (PARTITION BY axis ORDER BY bin) / sum(e) OVER (PARTITION BY axis) AS share FROM (SELECT axis, floor(c) AS bin, sum(energy) AS e, min(c) AS lo, max(c) AS hi FROM (SELECT 'xl' AS axis, xl AS c, energy FROM hits UNION ALL SELECT 'yl', yl, energy FROM hits UNION ALL SELECT 'zl', zl, energy FROM hits) GROUP BY ALL)) GROUP BY axis")
q("G6_color_anchors", lambda c: fr.color_anchors(c.hits), "$binning ~max_e ~p999", "SELECT binning, max(e) AS max_e, quantile_cont(e, 999e-3) AS p999 FROM (SELECT 'xy' AS binning, sum(m_e) AS e FROM cells GROUP BY ix, iy UNION ALL SELECT 'xz', sum(m_e) FROM cells GROUP BY ix, iz UNION ALL SELECT 'yz', sum(m_e) FROM cells GROUP BY iy, iz) GROUP BY 1")
q("G7_bin_rule", lambda c: fr.bin_rule(c.events), "lo hi off", "SELECT min(e1_bin) AS lo, max(e1_bin) AS hi, count(*) FILTER (WHERE e1_bin <> floor(e1)) AS off FROM ev")

q("P1_project_xy", lambda c: fr.project_xy(c.hits), "ix iy ~m_e m_n ~m_true ~m_pred ~m_eg ~m_s", "SELECT ix, iy, sum(m_e) AS m_e, sum(m_n) AS m_n, sum(m_true) AS m_true, sum(m_pred) AS m_pred, sum(m_eg) AS m_eg, sum(m_s) AS m_s FROM cells WHERE iz <= 2 GROUP BY ix, iy")
q("P2_project_depth", lambda c: fr.project_depth(c.hits), "panel ix iy iz ~e n", "SELECT CASE WHEN iy IS NULL THEN 2 ELSE 4 END AS panel, * FROM (SELECT ix, iy, iz, sum(m_e) AS e, sum(m_n) AS n FROM cells GROUP BY GROUPING SETS ((iy, iz), (ix, iz)))")
q("P3_event_frame", lambda c: jn.event_frame(c.events), "event_number ~psi ~ax ~ay ~d_entry", "SELECT * FROM fr")
q("P4_shower_frame", lambda c: fr.shower_frame(c.showers), "event_number b ~r11 ~r12 ~r13 ~r21 ~r31 ~r33", "SELECT event_number, b, cos(theta) * cos(phi) AS r11, cos(theta) * sin(phi) AS r12, -sin(theta) AS r13, -sin(phi) AS r21, sin(theta) * cos(phi) AS r31, cos(theta) AS r33 FROM sh")
q("P5_transform", lambda c: fr.in_shower_frame(c.hits, c.showers), "event_number cell_id b ~u ~v ~w", "SELECT h.event_number, cell_id, b, cos(s.theta) * cos(s.phi) * (x - p0x) + cos(s.theta) * sin(s.phi) * (y - p0y) - sin(s.theta) * (z - p0z) AS u, cos(s.phi) * (y - p0y) - sin(s.phi) * (x - p0x) AS v, sin(s.theta) * cos(s.phi) * (x - p0x) + sin(s.theta) * sin(s.phi) * (y - p0y) + cos(s.theta) * (z - p0z) AS w FROM hits h JOIN sh s ON h.event_number = s.event_number AND s.b = CASE WHEN h.origin = 'A' THEN 0 ELSE 1 END WHERE d IS NOT NULL")
q("P6_frame_stats", lambda c: fr.frame_stats(c.events), "n n_hits ~mean_entry ~median_entry ~sd_entry ~mean_d ~median_d ~slope_a ~sd_slope_a ~slope_b ~psi_resultant ill", "SELECT count(*) AS n, sum(n_hits) AS n_hits, avg(d_entry) AS mean_entry, median(d_entry) AS median_entry, stddev_samp(d_entry) AS sd_entry, avg(d) AS mean_d, median(d) AS median_d, avg(cos(phi_a - psi) * tan(theta_a)) AS slope_a, stddev_samp(cos(phi_a - psi) * tan(theta_a)) AS sd_slope_a, avg(cos(phi_b - psi) * tan(theta_b)) AS slope_b, sqrt(pow(avg(cos(psi)), 2) + pow(avg(sin(psi)), 2)) AS psi_resultant, count(*) FILTER (WHERE d_entry < 10) AS ill FROM fr")
q("P7_shower_stats", lambda c: fr.shower_stats(c.showers), "b n ~mean_cxl ~sd_cxl ~mean_cyl ~sd_cyl ~mean_czl ~sd_czl ~phi_resultant", "SELECT b, count(*) AS n, avg(cxl) AS mean_cxl, stddev_samp(cxl) AS sd_cxl, avg(cyl) AS mean_cyl, stddev_samp(cyl) AS sd_cyl, avg(czl) AS mean_czl, stddev_samp(czl) AS sd_czl, sqrt(pow(avg(cos(phi)), 2) + pow(avg(sin(phi)), 2)) AS phi_resultant FROM sh WHERE d IS NOT NULL GROUP BY b")
q("P8_accumulate_dframe", lambda c: fr.accumulate_dframe(c.hits, c.events), "jx jy layer ~e n", "SELECT CASE WHEN inside THEN jx ELSE -1 END AS jx, CASE WHEN inside THEN jy ELSE -1 END AS jy, layer, sum(v) AS e, count(*) AS n FROM (SELECT *, jx BETWEEN 0 AND 59 AND jy BETWEEN 0 AND 59 AS inside FROM (SELECT iz AS layer, energy / 4 AS v, floor((cos(psi) * (x + ox - ax) + sin(psi) * (y + oy - ay)) / 20) + 30 AS jx, floor((cos(psi) * (y + oy - ay) - sin(psi) * (x + ox - ax)) / 20) + 30 AS jy FROM hits JOIN fr USING (event_number), (SELECT ((i + 5e-1) / 2 - 5e-1) * 486e-1 AS ox, ((j + 5e-1) / 2 - 5e-1) * 505e-1 AS oy FROM range(2) a(i), range(2) b(j)) o)) GROUP BY ALL")
q("P9_accumulate_trans", lambda c: fr.accumulate_trans(c.hits).filter("abs(e) > 1e-7"), "bx by ~e", 'SELECT CAST(bx AS BIGINT) AS bx, CAST(cy AS BIGINT) AS "by", e FROM (SELECT bx, cy, sum(energy * greatest(0, least(ux + 243e-2, bx + 1) - greatest(ux, bx)) / 243e-2 * greatest(0, least(uy + 2525e-3, cy + 1) - greatest(uy, cy)) / 2525e-3) AS e FROM (SELECT *, floor(ux) + i AS bx, floor(uy) + j AS cy FROM (SELECT energy, (xt - 243e-1) / 20 + 20 AS ux, (yt - 2525e-2) / 20 + 20 AS uy FROM hits), range(4) a(i), range(4) b(j)) GROUP BY ALL) WHERE abs(e) > 1e-7')
q("P10_accumulate_local", lambda c: fr.accumulate_local(c.hits), "ju jv jw ~e", "SELECT CASE WHEN inside THEN ju ELSE -1 END AS ju, CASE WHEN inside THEN jv ELSE -1 END AS jv, jw, sum(v) AS e FROM (SELECT *, ju BETWEEN 0 AND 59 AND jv BETWEEN 0 AND 59 AS inside FROM (SELECT energy / 8 AS v, floor((xl + cos(theta) * cos(phi) * ox + cos(theta) * sin(phi) * oy - sin(theta) * oz) / 20) + 30 AS ju, floor((yl - sin(phi) * ox + cos(phi) * oy) / 20) + 30 AS jv, floor((zl + sin(theta) * cos(phi) * ox + sin(theta) * sin(phi) * oy + cos(theta) * oz) / 205e-1) AS jw FROM hits, (SELECT ((i + 5e-1) / 2 - 5e-1) * 486e-1 AS ox, ((j + 5e-1) / 2 - 5e-1) * 505e-1 AS oy, ((m + 5e-1) / 2 - 5e-1) * 205e-1 AS oz FROM range(2) a(i), range(2) b(j), range(2) d(m)) o)) GROUP BY ALL")
q("P11_frame_residual", lambda c: fr.frame_residual(c.hits), "~residual", "SELECT max(abs(zl - sin(theta) * cos(phi) * xt - sin(theta) * sin(phi) * yt - cos(theta) * zt)) AS residual FROM hits")
q("P12_voxels", lambda c: fr.voxels(c.hits), "vx vy vz ~e n ~peak", "SELECT ix // 2 AS vx, iy // 2 AS vy, iz AS vz, sum(m_e) AS e, sum(m_n) AS n, max(m_e) AS peak FROM cells GROUP BY ALL")
q("P13_voxel_rank", lambda c: fr.voxel_rank(fr.voxels(c.hits), 50, 0.2), "vx vy vz ~ratio $class", "SELECT vx, vy, vz, ratio, CASE WHEN ratio < 2e-1 THEN 'faint' WHEN row_number() OVER (ORDER BY ratio < 2e-1, e DESC, vz, vx, vy) <= 50 THEN 'drawn' ELSE 'capped' END AS class FROM (SELECT *, e / max(peak) OVER () AS ratio FROM (SELECT ix // 2 AS vx, iy // 2 AS vy, iz AS vz, sum(m_e) AS e, max(m_e) AS peak FROM cells GROUP BY ALL))")
q("P14_voxel_depth", lambda c: fr.voxels(c.hits).groupBy("vz").agg(F.sum("e").alias("e")), "vz ~e", "SELECT iz AS vz, sum(energy) AS e FROM hits GROUP BY 1")
q("P15_cells", lambda c: c.hits.groupBy("ix", "iy", "iz").agg(F.sum("energy").alias("e"), F.count("*").alias("n"), F.bit_or(F.when(F.col("origin") == "A", 1).when(F.col("origin") == "B", 2).otherwise(3)).alias("bits"), F.sum(F.when(fl.finite(F.col("shapcam")), F.col("shapcam"))).alias("s")), "ix iy iz ~e n bits ~s", "SELECT ix, iy, iz, sum(energy) AS e, count(*) AS n, bit_or(CASE origin WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END) AS bits, sum(shapcam) AS s FROM hits GROUP BY ALL")
q("P16_merge_cells", lambda c: fr.merge_cells(c.hits), "event_number cell_id ~e n ~map any_primary $species ~purity origin_code", "SELECT event_number, cell_id, sum(se) AS e, sum(sn) AS n, sum(eg) / sum(se) AS map, CASE WHEN min(sec) = 0 THEN 1 ELSE 0 END AS any_primary, first(particle_type ORDER BY se DESC, particle_type) AS species, max(se) / sum(se) AS purity, bit_or(org) AS origin_code FROM (SELECT event_number, cell_id, particle_type, sum(energy) AS se, count(*) AS sn, sum(energy * gradcam) AS eg, min(is_secondary) AS sec, bit_or(CASE origin WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END) AS org FROM hits GROUP BY ALL) GROUP BY ALL")
q("P17_daughter_mode", lambda c: fr.daughter_mode(c.hits), "$particle_type $daughter n", "SELECT * FROM (SELECT particle_type, daughter, count(*) AS n FROM (SELECT particle_type, unnest(string_split(daughter_type, ';')) AS daughter FROM hits) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY particle_type ORDER BY n DESC, daughter) = 1")
q("P18_centroids", lambda c: fr.centroids(c.hits), "~ax ~ay ~az ~bx ~by ~bz ~distance", 'SELECT *, sqrt((ax - bx) * (ax - bx) + (ay - "by") * (ay - "by")) AS distance FROM (SELECT sum(energy * seg_pred * x) / sum(energy * seg_pred) AS ax, sum(energy * seg_pred * y) / sum(energy * seg_pred) AS ay, sum(energy * seg_pred * z) / sum(energy * seg_pred) AS az, sum(r * x) / sum(r) AS bx, sum(r * y) / sum(r) AS "by", sum(r * z) / sum(r) AS bz FROM (SELECT *, greatest(energy - energy * seg_pred, 0) AS r FROM hits))')
q("P19_shower_axes", lambda c: fr.shower_axes(c.hits, 0.6), "iz ~e ~cx ~cy", "SELECT * FROM (SELECT iz, sum(energy) AS e, sum(energy * x) / sum(energy) AS cx, sum(energy * y) / sum(energy) AS cy FROM hits GROUP BY iz) QUALIFY e >= 6e-1 * max(e) OVER ()")
q("P20_layer_profile", lambda c: c.hits.groupBy(F.round(F.col("zt") / 20.5).cast("int").alias("kt")).agg(F.sum("energy").alias("e"), F.sum(F.col("energy") * F.col("gradcam")).alias("eg")), "kt ~e ~eg", "SELECT round(zt / 205e-1) AS kt, sum(energy) AS e, sum(energy * gradcam) AS eg FROM hits GROUP BY 1")
q("P21_reach", lambda c: fr.reach(c.hits), "k n", "SELECT k, count(*) FILTER (WHERE s <= 6 - k) AS n FROM range(7) r(k), (SELECT event_number, min(iz) AS s FROM hits GROUP BY event_number, origin = 'A') t GROUP BY k")
q("P22_pool_layers", lambda c: fr.pool_layers(c.hits), "grp ~e n layers", "SELECT CASE WHEN iz < 1 THEN 0 WHEN iz < 3 THEN 1 ELSE 2 END AS grp, sum(energy) AS e, count(*) AS n, count(DISTINCT iz) AS layers FROM hits GROUP BY 1")
q("P23_fit_window", lambda c: fr.fit_window(marginal(c)), "half ~outside ~total", f"WITH m AS ({MARGINAL}), s AS (SELECT *, sum(e) OVER (ORDER BY bin) / sum(e) OVER () AS share FROM m), h AS (SELECT greatest(2, -min(bin) FILTER (WHERE share >= 5e-3), min(bin) FILTER (WHERE share >= 995e-3)) AS half FROM s) SELECT half, coalesce(sum(e) FILTER (WHERE bin < -half OR bin > half), 0) AS outside, sum(e) AS total FROM m, h GROUP BY half")
q("P24_islands", lambda c: fr.islands(marginal(c)), "island lo hi ~e ~share", f"WITH m AS ({MARGINAL}) SELECT island, min(bin) AS lo, max(bin) AS hi, sum(e) AS e, sum(e) / (SELECT sum(e) FROM m) AS share FROM (SELECT *, sum(cut) OVER (ORDER BY bin) AS island FROM (SELECT *, CASE WHEN bin - lag(bin) OVER (ORDER BY bin) > 2 THEN 1 ELSE 0 END AS cut FROM m)) GROUP BY island")


def local_panels(c):
    axis = lambda a: F.floor(F.col(a) / 20).cast("int")
    rows = F.array(*[F.struct(F.lit(p).alias("panel"), axis("xl").alias("i"), axis(a).alias("j")) for p, a in (("xy", "yl"), ("xz", "zl"))])
    return c.hits.select("energy", F.inline(rows)).groupBy("panel", "i", "j").agg(F.sum("energy").alias("e"))


#: Shares so large that a part of the fixture's own field lies beyond its cap.
CAP = {"floor": 5e-3, "low": 1e-3, "high": 0.999, "least": 200.0, "gap": 20.0, "island": 0.01}


def _cap_sql(floor: float, low: float, high: float, least: float, gap: float, island: float) -> str:
    n = lambda x: f"CAST('{x}' AS DOUBLE)"
    return f"""WITH c AS (SELECT *, e >= {n(floor)} * max(e) OVER (PARTITION BY panel) AS shown FROM (SELECT panel, CAST(floor(xl / 20) AS INT) AS i, CAST(floor(a / 20) AS INT) AS j, sum(energy) AS e
        FROM (SELECT 'xy' AS panel, xl, yl AS a, energy FROM hits UNION ALL SELECT 'xz', xl, zl, energy FROM hits) GROUP BY ALL)),
      b AS (SELECT panel, i, sum(e) AS e, count(*) FILTER (WHERE shown) AS dn, coalesce(sum(e) FILTER (WHERE shown), 0) AS de, coalesce(sum(e * (20 * j + 10)) FILTER (WHERE shown), 0) AS dm FROM c GROUP BY ALL),
      s AS (SELECT *, sum(e) OVER (PARTITION BY panel ORDER BY i) / sum(e) OVER (PARTITION BY panel) AS share FROM b),
      p AS (SELECT panel, greatest({n(least)}, 20 * greatest(abs(min(i) FILTER (WHERE share >= {n(low)})), abs(1 + min(i) FILTER (WHERE share >= {n(high)})))) AS half_plain, sum(e) AS total FROM s GROUP BY panel),
      r AS (SELECT *, sum(cut) OVER (PARTITION BY panel ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY panel ORDER BY i) > 1 + {int(gap / 20)} THEN 1 ELSE 0 END AS cut FROM b WHERE dn > 0)),
      k AS (SELECT *, de >= {n(island)} * sum(de) OVER (PARTITION BY panel) AS large FROM (SELECT panel, run, min(i) AS a, max(i) AS z, sum(de) AS de FROM r GROUP BY ALL)),
      d AS (SELECT panel, count(*) AS components, count(*) FILTER (WHERE kept) AS kept, max(20 * greatest(abs(a), abs(z + 1))) FILTER (WHERE kept) AS half_drawn FROM (SELECT *, large OR NOT bool_or(large) OVER (PARTITION BY panel) AS kept FROM k) GROUP BY panel),
      h AS (SELECT *, least(half_plain, greatest({n(least)}, half_drawn)) AS half FROM p JOIN d USING (panel))
      SELECT panel, components, kept, half_plain, half_drawn, half, CASE WHEN half < half_plain THEN 1 ELSE 0 END AS applied, sum(CASE WHEN 20 * (i + 1) <= -half OR 20 * i >= half THEN e ELSE 0 END) / any_value(total) AS share_out,
        coalesce(sum(dn) FILTER (WHERE 20 * (i + 1) <= -half), 0) AS n_lo, coalesce(sum(dn) FILTER (WHERE 20 * i >= half), 0) AS n_hi, coalesce(sum(de) FILTER (WHERE 20 * (i + 1) <= -half), 0) AS e_lo, coalesce(sum(de) FILTER (WHERE 20 * i >= half), 0) AS e_hi,
        sum(dm) FILTER (WHERE 20 * (i + 1) <= -half) / nullif(sum(de) FILTER (WHERE 20 * (i + 1) <= -half), 0) AS at_lo, sum(dm) FILTER (WHERE 20 * i >= half) / nullif(sum(de) FILTER (WHERE 20 * i >= half), 0) AS at_hi FROM b JOIN h USING (panel) GROUP BY ALL"""


q("P24_cap_windows", lambda c: fr.cap_windows(local_panels(c), **CAP), "$panel components kept ~half_plain ~half_drawn ~half applied ~share_out n_lo n_hi ~e_lo ~e_hi ~at_lo ~at_hi", _cap_sql(**CAP))
q("P25_ratio_resample", lambda c: jn.resample(c.hits.groupBy(F.col("x").alias("at")).agg(F.sum(F.col("energy") * F.col("gradcam")).alias("v")).withColumns({"lo": F.col("at") - 24.3, "hi": F.col("at") + 24.3}), [i * 35.0 - 40 for i in range(32)]).withColumnRenamed("v", "num").join(jn.resample(c.hits.groupBy(F.col("x").alias("at")).agg(F.sum("energy").alias("v")).withColumns({"lo": F.col("at") - 24.3, "hi": F.col("at") + 24.3}), [i * 35.0 - 40 for i in range(32)]), "bin").withColumn("ratio", F.try_divide("num", "v")), "bin ~ratio", "SELECT i AS bin, sum(g * o) / sum(v * o) AS ratio FROM (SELECT i, g, v, (least(pos + 243e-1, i * 35 - 5) - greatest(pos - 243e-1, i * 35 - 40)) AS o FROM (SELECT x AS pos, sum(energy) AS v, sum(energy * gradcam) AS g FROM hits GROUP BY x) s, range(31) r(i)) WHERE o > 0 GROUP BY i")
q("P26_kernel_resample", lambda c: fr.kernel_resample(marginal(c)), "bin ~e", f"WITH k AS (SELECT o, exp(-5e-1 * o * o) / sum(exp(-5e-1 * o * o)) OVER () AS wt FROM range(-3, 4) r(o)) SELECT bin + o AS bin, sum(e * wt) AS e FROM ({MARGINAL}) m, k GROUP BY 1")
EDGES = (-300.0, -200.0, -120.0, -70.0, -30.0, -10.0, 0.0, 15.0, 40.0, 90.0, 150.0, 260.0, 400.0)


def uneven_sources(c):
    """Bins of 20 mm about zero and of 80 mm beyond."""
    b = F.floor(F.col("xl") / 20)
    lo = F.when(F.abs(b) < 5, b * 20).otherwise(F.floor(b / 4) * 80)
    return c.hits.groupBy(lo.cast("double").alias("lo"), (lo + F.when(F.abs(b) < 5, 20).otherwise(80)).cast("double").alias("hi")).agg(F.sum("energy").alias("v"))


def _kernel_sql(below: str, more: str = "", from_: str = "") -> str:
    edges = " UNION ALL ".join(f"SELECT {i} AS k, CAST({e} AS DOUBLE) AS pos" for i, e in enumerate(EDGES))
    return f"""WITH s AS (SELECT lo, hi, sum(energy) AS v FROM (SELECT energy, CASE WHEN abs(b) < 5 THEN b * 20e0 ELSE floor(b / 4) * 80e0 END AS lo, CASE WHEN abs(b) < 5 THEN b * 20e0 + 20 ELSE floor(b / 4) * 80e0 + 80 END AS hi FROM (SELECT energy, floor(xl / 20) AS b FROM hits)) GROUP BY ALL),
      e AS ({edges}){more}, g AS (SELECT k, sum(v * {below}) AS under FROM s, e {from_} GROUP BY k), t AS (SELECT sum(v) AS total FROM s)
      SELECT k AS bin, coalesce(lead(under) OVER (ORDER BY k), total) - under AS v FROM g, t UNION ALL SELECT -1, under FROM g WHERE k = 0"""


RAMP = "{u} * (1 + {f}) / 2 + exp(-5e-1 * {u} * {u}) / sqrt(2 * pi())"
SERIES = ", u AS (SELECT DISTINCT (e.pos - c) / 25 AS u FROM e, (SELECT lo AS c FROM s UNION SELECT hi FROM s)), f AS (SELECT u, CASE WHEN abs(u) > 9 THEN sign(u) ELSE sign(u) * (SELECT sum(exp((2 * r.i + 1) * ln(greatest(abs(u) / sqrt(2), 1e-300)) - u * u / 2 - lgamma(r.i + 15e-1))) FROM range(161) r(i)) END AS f FROM u)"
q("P26_kernel_gaussian", lambda c: kn.spread(uneven_sources(c), list(EDGES), kn.gaussian(25.0)), "bin ~v", _kernel_sql(f"(({RAMP.format(u='a.u', f='a.f')}) - ({RAMP.format(u='z.u', f='z.f')})) * 25 / (hi - lo)", SERIES, "JOIN f a ON a.u = (e.pos - lo) / 25 JOIN f z ON z.u = (e.pos - hi) / 25"))
TENT = "(e.pos - (lo + hi) / 2) / (hi - lo)"
q("P26_kernel_tent", lambda c: kn.spread(uneven_sources(c), list(EDGES), kn.tent()), "bin ~v", _kernel_sql(f"CASE WHEN {TENT} <= -1 THEN 0 WHEN {TENT} >= 1 THEN 1 WHEN {TENT} <= 0 THEN pow(1 + {TENT}, 2) / 2 ELSE 1 - pow(1 - {TENT}, 2) / 2 END"))
q("P27_top_cells", lambda c: fr.top_cells(fl.summed(c.hits, "ix", "iy", "iz"), "m_s", 20, "ix", "iy", "iz"), "ix iy iz ~m_s", "SELECT * FROM cells ORDER BY abs(round(m_s, 9)) DESC, ix, iy, iz LIMIT 20")
DETREND = f"SELECT *, lag(rest) OVER (ORDER BY bin) AS before FROM (SELECT bin, e, e - avg(e) OVER (ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS rest FROM ({MARGINAL}) m)"
q("P28_comb", lambda c: fr.comb(marginal(c)), "~lag1 n comb", f"SELECT corr(rest, before) AS lag1, count(*) AS n, CASE WHEN corr(rest, before) < -1e-1 THEN 1 ELSE 0 END AS comb FROM ({DETREND})")
def _axis_sql() -> str:
    cov = lambda a, b: f"sum(energy * {a} * {b}) / sum(energy) - sum(energy * {a}) / sum(energy) * sum(energy * {b}) / sum(energy) AS {a}{b}"
    m = f"SELECT event_number, count(*) AS n, {', '.join(cov(*p) for p in ('xx', 'yy', 'zz', 'xy', 'xz', 'yz'))} FROM (SELECT event_number, energy, x, y, z - 36624e-1 AS z FROM single) GROUP BY 1"
    s = f"SELECT *, (xx + yy + zz) / 3 AS q, sqrt(greatest(0, (pow(2 * xx - yy - zz, 2) + pow(2 * yy - xx - zz, 2) + pow(2 * zz - xx - yy, 2)) / 54 + (xy * xy + xz * xz + yz * yz) / 3)) AS r FROM ({m})"
    det = "((xx - q) * (yy - q) * (zz - q) + 2 * xy * xz * yz - (xx - q) * yz * yz - (yy - q) * xz * xz - (zz - q) * xy * xy)"
    top = f"SELECT *, CASE WHEN r < 1e-9 THEN q ELSE q + 2 * r * cos(acos(greatest(-1e0, least(1e0, {det} / (2 * pow(r, 3))))) / 3) END AS l FROM ({s})"
    parts = f"SELECT *, greatest(0, (yy - l) * (zz - l) - yz * yz) + greatest(0, (xx - l) * (zz - l) - xz * xz) AS ac, greatest(0, (xx - l) * (yy - l) - xy * xy) AS al FROM ({top})"
    return f"SELECT event_number, n, xx / 1e3 AS xx, yy / 1e3 AS yy, zz / 1e3 AS zz, xy / 1e3 AS xy, 3 * q / 1e3 AS trace, l / 1e3 AS largest, CASE WHEN q > 1e-3 THEN l / (3 * q) END AS share, CASE WHEN q > 1e-3 AND ac + al > 1e-6 * q * q THEN atan2(sqrt(ac), sqrt(al)) END AS angle FROM ({parts})"


q("P29_principal_axis", lambda c: fr.principal_axis(c.single).selectExpr("event_number", "n", *[f"{a} / 1e3 AS {a}" for a in ("xx", "yy", "zz", "xy", "largest")], "3 * q / 1e3 AS trace", "share", "angle"), "event_number n ~xx ~yy ~zz ~xy ~trace ~largest ~share ~angle", _axis_sql())
q("P30_event_panels", lambda c: fr.event_panels(c.hits, fl.select(c.events, (5, 10))), "event_number $panel i j ~e", "SELECT event_number, panel, floor(a / 20) AS i, floor(b / 20) AS j, sum(energy) AS e FROM (" + " UNION ALL ".join(f"SELECT event_number, '{n}_{a}{b}' AS panel, {a}{f} AS a, {b}{f} AS b, energy FROM hits" for n, f in (("lab", ""), ("trans", "t"), ("local", "l")) for a, b in ("xy", "xz", "yz")) + ") WHERE event_number IN (SELECT event_number FROM ev WHERE e1 BETWEEN 5 AND 10) GROUP BY ALL")
q("P31_density", lambda c: fr.density(fr.project_xy(c.hits), c.events.agg(F.count("*").alias("n_events")), 48.6 * 50.5), "ix iy ~density ~peak", "SELECT ix, iy, density, max(density) OVER () AS peak FROM (SELECT ix, iy, sum(m_e) / ((SELECT count(*) FROM ev) * 486e-1 * 505e-1) AS density FROM cells WHERE iz <= 2 GROUP BY ix, iy)")
q("P32_floor_mask", lambda c: fr.floor_mask(fl.summed(c.hits, "ix", "iy", "iz"), 0.5), "drawn masked ~masked_e", "SELECT count(*) FILTER (WHERE r >= 5e-1) AS drawn, count(*) FILTER (WHERE r < 5e-1) AS masked, coalesce(sum(m_e) FILTER (WHERE r < 5e-1), 0) AS masked_e FROM (SELECT *, m_e / max(m_e) OVER () AS r FROM cells)")
q("P33_event_window", lambda c: fr.event_window(c.hits), "event_number ~lo ~hi n_out ~e_out", "SELECT event_number, max(lo) AS lo, max(hi) AS hi, count(*) FILTER (WHERE x < lo OR x > hi) AS n_out, coalesce(sum(energy) FILTER (WHERE x < lo OR x > hi), 0) AS e_out FROM (SELECT *, min(x) FILTER (WHERE s >= 5e-2) OVER w - 1 AS lo, min(x) FILTER (WHERE s >= 95e-2 - 1e-9) OVER w + 1 AS hi FROM (SELECT event_number, x, energy, sum(energy) OVER (PARTITION BY event_number ORDER BY x) / sum(energy) OVER (PARTITION BY event_number) AS s FROM hits) WINDOW w AS (PARTITION BY event_number)) GROUP BY 1")
q("P34_event_attention", lambda c: fr.event_attention(c.some("event_number", "iz", "energy", "shapcam")), "event_number iz ~up ~down ~e", "SELECT event_number, iz, sum(greatest(energy * shapcam, 0)) AS up, sum(least(energy * shapcam, 0)) AS down, sum(energy) AS e FROM hits GROUP BY ALL")
