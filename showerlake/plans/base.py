"""Queries of filters, derived columns, joins and event tables."""

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import filters as fl
from ..operators import joins as jn
from ..operators import models as md
from .registry import FEATURE_SQL, q

HIT = "event_number cell_id"
LABEL = "SELECT CASE WHEN p >= 2 THEN 1 ELSE 0 END AS label, count(*) AS n, 0 AS disagree FROM sh GROUP BY 1"

# --- filters and derived columns ----------------------------------------------------------------
q("F1_keep_hits", lambda c: fl.keep_hits(c.raw), f"{HIT} $origin ~energy ~xl ~yl ~zl", "SELECT * FROM raw WHERE energy > 0")
q("F2_audit_hits", lambda c: fl.audit_hits(c.raw), "rows bad_coordinate bad_energy no_energy bad_origin kept", "SELECT count(*) AS rows, 0 AS bad_coordinate, 0 AS bad_energy, count(*) FILTER (WHERE energy <= 0) AS no_energy, 0 AS bad_origin, count(*) FILTER (WHERE energy > 0) AS kept FROM raw")
q("F3_sanitize_batch", lambda c: fl.sanitize_batch(c.raw), "not_finite no_energy negative_z kept ~span_x ~span_y ~span_z ~max_energy", "SELECT 0 AS not_finite, count(*) FILTER (WHERE energy <= 0) AS no_energy, 0 AS negative_z, count(*) FILTER (WHERE energy > 0) AS kept, max(x) FILTER (WHERE energy > 0) - min(x) FILTER (WHERE energy > 0) AS span_x, max(y) FILTER (WHERE energy > 0) - min(y) FILTER (WHERE energy > 0) AS span_y, max(z) FILTER (WHERE energy > 0) - min(z) FILTER (WHERE energy > 0) AS span_z, max(energy) AS max_energy FROM raw")
q("F4_select", lambda c: fl.select(c.events, (2, 12), (1, 15), (0, 300)), "event_number ~e1 ~e2 ~d", "SELECT * FROM ev WHERE e1 BETWEEN 2 AND 12 AND e2 BETWEEN 1 AND 15 AND d BETWEEN 0 AND 300")
q("F4_select_undefined_d", lambda c: fl.select(c.events, (2, 12), None, (0, 100), True), "event_number ~e1 ~d", "SELECT * FROM ev WHERE e1 BETWEEN 2 AND 12 AND (d BETWEEN 0 AND 100 OR d IS NULL)")
q("F5_unbounded", lambda c: fl.select(c.events), "event_number n_hits ~d", "SELECT * FROM ev")
q("F6_particle_filter", lambda c: fl.particle_filter(c.events, (5, 15), (10, 25)), "event_number ~e1 ~e2", "SELECT * FROM ev WHERE (n_own_a > 0 AND e1 BETWEEN 5 AND 15 AND degrees(theta_a) BETWEEN 10 AND 25) OR (n_own_b > 0 AND e2 BETWEEN 5 AND 15 AND degrees(theta_b) BETWEEN 10 AND 25)")
q("F7_frame_gate", lambda c: c.events.agg(F.count("*").alias("n"), F.count_if(fl.frame_gate("two")).alias("framed")), "n framed", "SELECT count(*) AS n, count(d) AS framed FROM ev")
q("F8_showers", lambda c: c.showers, "event_number b ~p bin ~theta ~phi ~e_own n_own ~cxl", "SELECT * FROM sh")
q("F9_own_shower", lambda c: c.hits.groupBy("origin", fl.own_shower(F.col("origin")).alias("b")).count(), "$origin b count", "SELECT origin, CASE origin WHEN 'A' THEN 0 ELSE 1 END AS b, count(*) AS count FROM hits GROUP BY origin")
q("F10_frame_xyz", lambda c: fl.frame_xyz(c.hits, "trans"), f"{HIT} ~u ~v ~w", "SELECT *, xt AS u, yt AS v, round(zt / 205e-1) * 205e-1 AS w FROM hits")
q("F10_frame_xyz_laboratory", lambda c: fl.frame_xyz(c.hits, "lab", ([i * 48.0 + (i % 2) * 4.4 for i in range(20)], [i * 50.5 for i in range(3)], [3662.4 + 20.5 * i for i in range(7)])), f"{HIT} ~u ~v ~w", "SELECT *, x AS u, y AS v, z AS w FROM hits")
q("F11_d_slice", lambda c: c.events.groupBy(fl.d_slice(F.col("d")).alias("slice")).agg(F.count("*").alias("n")), "slice n", "SELECT CASE WHEN d IS NULL THEN -1 WHEN d <= 50 THEN 0 WHEN d <= 100 THEN 1 WHEN d <= 150 THEN 2 WHEN d <= 200 THEN 3 ELSE 4 END AS slice, count(*) AS n FROM ev GROUP BY 1")
q("F12_p_window", lambda c: c.showers.groupBy("b", fl.p_window(F.col("p")).alias("win")).agg(F.count("*").alias("n")), "b win n", "SELECT b, CASE WHEN p >= 15e-1 AND p < 25e-1 THEN 0 WHEN p >= 45e-1 AND p < 55e-1 THEN 1 WHEN p >= 95e-1 AND p < 105e-1 THEN 2 ELSE -2 END AS win, count(*) AS n FROM sh GROUP BY ALL")
q("F13_p_bin", lambda c: fl.p_bin(c.showers), "bin n ~p_min ~p_max $label", "SELECT bin, count(*) AS n, min(p) AS p_min, max(p) AS p_max, concat(bin, '-', bin + 1) AS label FROM sh GROUP BY bin")
q("F14_binary_label", lambda c: fl.binary_label(c.showers), "label n disagree", LABEL)
q("F15_group_key", lambda c: c.events.groupBy(fl.group_key(F.col("event_number")).alias("g")).agg(F.count("*").alias("n"), F.sum("e_dep").alias("e")), "g n ~e", "SELECT event_number % 64 AS g, count(*) AS n, sum(e_dep) AS e FROM ev GROUP BY 1")
q("F16_measures", lambda c: fl.summed(c.hits, "ix", "iy", "iz"), "ix iy iz ~m_e m_n ~m_true ~m_pred ~m_eg ~m_g ~m_es_pos ~m_es_neg ~m_s", "SELECT * FROM cells")
q("F17_channel", lambda c: fl.channel(fl.summed(c.hits, "ix", "iy", "iz")), "ix iy iz ~density ~attention_energy ~attention_count ~signed", "SELECT ix, iy, iz, m_e AS density, m_eg / m_e AS attention_energy, m_g / m_n AS attention_count, m_es_pos + m_es_neg AS signed FROM cells")
q("F18_quantize", lambda c: fl.summed(c.hits, "ix", "iy", "iz").withColumn("code", fl.quantize(F.col("m_e"), -1, 2)), "ix iy iz code", "SELECT *, CASE WHEN m_e <= 0 THEN 0 WHEN log10(m_e) < -1 THEN 1 ELSE least(255, 2 + floor((log10(m_e) + 1) / 3 * 253)) END AS code FROM cells")
q("F19_quantise_xy", lambda c: fl.quantise_xy(c.hits).groupBy("jx", "jy", "jz").agg(F.count("*").alias("n")), "jx jy jz n", "SELECT CASE WHEN floor(xt / 20) BETWEEN -25 AND 24 THEN floor(xt / 20) + 25 ELSE -1 END AS jx, CASE WHEN floor(yt / 20) BETWEEN -25 AND 24 THEN floor(yt / 20) + 25 ELSE -1 END AS jy, least(7, greatest(0, floor(zt / 205e-1))) AS jz, count(*) AS n FROM hits GROUP BY ALL")
q("F20_project_rows", lambda c: fl.project_rows(c.hits), f"{HIT} ix iy iz org kt ~energy ~xt ~yl ~seg_pred", "SELECT *, CASE origin WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END AS org, round(zt / 205e-1) AS kt FROM hits")

# --- joins -------------------------------------------------------------------------------------
q("J1_with_ordinals", lambda c: jn.with_ordinals(c.hits), f"{HIT} kx ky kz", "SELECT event_number, cell_id, dense_rank() OVER (ORDER BY x) - 1 AS kx, dense_rank() OVER (ORDER BY y) - 1 AS ky, dense_rank() OVER (ORDER BY z) - 1 AS kz FROM hits")
q("J2_join_showers", lambda c: jn.join_showers(c.hits, c.showers), f"{HIT} b ~share", "SELECT h.event_number, h.cell_id, s.b, h.energy / s.e_own AS share FROM hits h JOIN sh s ON h.event_number = s.event_number AND s.b = CASE WHEN h.origin = 'A' THEN 0 ELSE 1 END")
q("J3_join_frame", lambda c: jn.join_frame(c.hits, jn.event_frame(c.events)), f"{HIT} ~dx ~dy", "SELECT h.event_number, h.cell_id, cos(psi) * (x - ax) + sin(psi) * (y - ay) AS dx, -sin(psi) * (x - ax) + cos(psi) * (y - ay) AS dy FROM hits h JOIN fr USING (event_number)")
q("J4_splat", lambda c: ev.splat(c.hits, 2, 2).groupBy("iz").agg(F.count("*").alias("n"), F.sum("v").alias("e"), F.sum(F.col("v") * (F.col("x") + F.col("ox"))).alias("ex")), "iz n ~e ~ex", "SELECT iz, 8 * count(*) AS n, sum(energy) AS e, sum(energy * x) AS ex FROM hits GROUP BY iz")
q("J5_event_table", lambda c: jn.event_table(c.hits), "event_number n_hits n_cells n_split n_bad_split ~e_own_a ~e_own_b", "SELECT ev.event_number, n_hits, n_cells, n_split, n_bad_split, e_own_a, e_own_b FROM ev LEFT JOIN (SELECT event_number, count(*) AS n_cells, count(*) FILTER (WHERE n > 1) AS n_split, count(*) FILTER (WHERE n > 1 AND o < n) AS n_bad_split FROM (SELECT event_number, cell_id, count(*) AS n, count(DISTINCT origin) AS o FROM hits GROUP BY ALL) GROUP BY event_number) USING (event_number)")
q("J6_restrict", lambda c: jn.restrict(ev.layers(c.hits), fl.select(c.events, (5, 10))), "event_number b layer ~e n", "SELECT * FROM lay WHERE event_number IN (SELECT event_number FROM ev WHERE e1 BETWEEN 5 AND 10)")
q("J7_feature_parity", lambda c: jn.parity_sides(c.events.filter("d IS NOT NULL"), c.singles.filter("n_hits > 2")), "shared only_left only_right", "SELECT count(*) FILTER (WHERE l AND r) AS shared, count(*) FILTER (WHERE l AND NOT r) AS only_left, count(*) FILTER (WHERE r AND NOT l) AS only_right FROM (SELECT coalesce(ev.event_number, sg.event_number) AS event_number, coalesce(d IS NOT NULL, FALSE) AS l, coalesce(sg.n_hits > 2, FALSE) AS r FROM ev FULL JOIN sg ON ev.event_number = sg.event_number)")
q("J8_consistency", lambda c: jn.differing(c.events.selectExpr("event_number", "n_own_a AS n"), ev.layers(c.hits).filter("b = 0").groupBy("event_number").agg(F.sum("n").alias("n"))), "event_number left_n right_n", "SELECT event_number, n_own_a AS left_n, NULL AS right_n FROM ev WHERE n_own_a = 0")
q("J9_holdout", lambda c: jn.restrict(md.split(c.showers.select("event_number", "b", "p", "energy_pred")).filter("holdout = 1"), fl.select(c.events, (5, 10))), "event_number b ~p ~energy_pred", "SELECT * FROM sh WHERE (event_number * 7919) % 1000003 % 5 = 0 AND e1 BETWEEN 5 AND 10")
q("J10_first_layer", lambda c: jn.first_layer(c.hits), f"{HIT} b ~z", "SELECT * FROM (SELECT event_number, cell_id, z, CASE WHEN origin = 'A' THEN 0 ELSE 1 END AS b, min(z) OVER (PARTITION BY event_number, origin = 'A') AS z0 FROM hits) WHERE z = z0")
q("J11_resample", lambda c: jn.resample(c.hits.groupBy(F.col("x").alias("at")).agg(F.sum("energy").alias("v")).withColumns({"lo": F.col("at") - 24.3, "hi": F.col("at") + 24.3}), [i * 35.0 - 40 for i in range(32)]), "bin ~v", "SELECT i AS bin, sum(v * (least(pos + 243e-1, i * 35 - 5) - greatest(pos - 243e-1, i * 35 - 40)) / 486e-1) AS v FROM (SELECT x AS pos, sum(energy) AS v FROM hits GROUP BY x) s, range(31) r(i) WHERE pos - 243e-1 < i * 35 - 5 AND pos + 243e-1 > i * 35 - 40 GROUP BY i")
q("J12_n_selected", lambda c: jn.counted_gate(fl.select(c.events, (5, 10))), "n_selected n_framed ~mean_d", "SELECT count(*) AS n_selected, count(d) AS n_framed, avg(d) AS mean_d FROM ev WHERE e1 BETWEEN 5 AND 10")

# --- event tables ------------------------------------------------------------------------------
EV = "event_number n_hits n_a n_b n_ab ~e_dep ~e_ab ~e1 ~e2 ~d ~d_t ~d_l"
q("E1_events_two", lambda c: c.events, EV, "SELECT * FROM ev")
q("E2_events_single", lambda c: c.singles, "event_number n_hits ~e_dep n_primary ~e_primary n_parent_mismatch ~cx ~cyt ~czl", "SELECT * FROM sg")
q("E3_entry_point", lambda c: c.events, "event_number ~p0ax ~p0ay ~p0az ~p0bx ~p0by ~p0bz", "SELECT * FROM ev")
q("E4_primary_type", lambda c: c.singles, "event_number $primary_type", "SELECT * FROM sg")
q("E5_segmentation_sums", lambda c: c.events, "event_number ~e_a_pred ~e_b_pred ~e_a_true ~e_b_true ~abs_err ~wabs_err ~sq_err n_correct n_true n_pred n_tp", "SELECT * FROM ev")
q("E6_net_outputs", lambda c: c.events, "event_number ~energy_pred_a ~energy_pred_b ~angle_pred_a ~angle_pred_b", "SELECT * FROM ev")
q("E7_zero_mask", lambda c: ev.zero_mask(c.hits), "event_number zero_mask", "SELECT event_number, CASE WHEN max(abs(gradcam)) = 0 THEN 1 ELSE 0 END + CASE WHEN max(abs(shapcam)) = 0 THEN 2 ELSE 0 END AS zero_mask FROM hits GROUP BY 1")
q("E8_spreads", lambda c: ev.spreads(c.hits), "event_number ~model_spread ~p0_spread", "SELECT event_number, 0 AS model_spread, greatest(max(gx), max(gy), max(gz)) AS p0_spread FROM (SELECT event_number, origin = 'A' AS a, max(x - xt) - min(x - xt) AS gx, max(y - yt) - min(y - yt) AS gy, max(z - zt) - min(z - zt) AS gz FROM hits GROUP BY ALL) GROUP BY 1")
q("E9_cell_census", lambda c: ev.cell_census(c.hits), "event_number n_cells n_split n_bad_split ~max_cell", "SELECT event_number, count(*) AS n_cells, count(*) FILTER (WHERE n > 1) AS n_split, count(*) FILTER (WHERE n > 1 AND o < n) AS n_bad_split, max(e) AS max_cell FROM (SELECT event_number, cell_id, count(*) AS n, sum(energy) AS e, count(DISTINCT origin) AS o FROM hits GROUP BY ALL) GROUP BY 1")
q("E10_shape_sums", lambda c: ev.shape_sums(c.single), "event_number n ~e n_neg ~e_neg ~e_rho ~e_rho2 ~sum_r_ ~sd_r_t ~max_r_l ~sum_er_l ~sum_th_l ~sd_th_l ~sum_ph_t ~sum_c_l ~sum_s_l ~min_xl ~max_zl ~sum_eyt", "SELECT * FROM shapes")
SHAPES = [n for n in ev.FEATURES if n not in ("volume", "number_density", "energy_density")]


def shapes(c):
    """The 17 features in each frame; volume and densities as logarithms, which keep their digits."""
    sums = ev.shape_sums(c.single)
    parts = [ev.features(sums, f).withColumns({"frame": F.lit(f or "lab")} | {n: F.log10(n) for n in ("volume", "number_density", "energy_density")}) for f in ev.FRAMES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _features_sql(f: str) -> str:
    import re

    own = lambda text: re.sub(r"_l\b", f"_{f}", re.sub(r"(?<=[xyz])l\b", f, text))
    named = ", ".join(f"{own(v)} AS {k}" for k, v in FEATURE_SQL.items())
    return f"SELECT *, log10(width * height * depth) AS volume, log10(n / (width * height * depth)) AS number_density, log10(e / (width * height * depth)) AS energy_density FROM (SELECT '{f or 'lab'}' AS frame, event_number, n, e, {named} FROM shapes)"


q("E11_features", shapes, "$frame event_number " + " ".join(f"~{n}" for n in ev.FEATURES), " UNION ALL ".join(_features_sql(f) for f in ev.FRAMES))
q("E12_circular_mean", lambda c: ev.circular_of_sums(ev.shape_sums(c.single)), "event_number ~circ_mean ~resultant", "SELECT event_number, atan2(sum_s_l, sum_c_l) AS circ_mean, sqrt(sum_s_l * sum_s_l + sum_c_l * sum_c_l) / n AS resultant FROM shapes")
q("E13_circular_spread", lambda c: ev.circular_of_sums(ev.shape_sums(c.single)), "event_number ~resultant ~circ_sd ~spread_circ", "SELECT *, sd_th_l + circ_sd AS spread_circ FROM (SELECT *, sqrt(-2 * ln(least(1e0, resultant))) AS circ_sd FROM (SELECT *, sqrt(sum_s_l * sum_s_l + sum_c_l * sum_c_l) / n AS resultant FROM shapes))")
q("E14_events_features", lambda c: ev.events_features(c.singles.select("event_number", "p", "theta", "cx", "cy")), "repeated nulled n n_label", "SELECT count(*) - count(DISTINCT event_number) AS repeated, 0 AS nulled, count(*) AS n, count(*) FILTER (WHERE p >= 2) AS n_label FROM sg")
q("E15_layers", lambda c: ev.layers(c.hits), "event_number b layer ~e n ~e_u ~e_v ~e_rho ~e_rho2", "SELECT * FROM lay")
SUB = "SELECT ((i + 5e-1) / 6 - 5e-1) * 486e-1 AS ox, ((j + 5e-1) / 6 - 5e-1) * 505e-1 AS oy, ((m + 5e-1) / 2 - 5e-1) * 205e-1 AS oz FROM range(6) r1(i), range(6) r2(j), range(2) r3(m)"
KEYED = f"SELECT event_number, CASE WHEN origin = 'A' THEN 0 ELSE 1 END AS b, energy / 72 AS v, zl < -1025e-2 AS neg, CAST(floor((zl + sin(theta) * cos(phi) * ox + sin(theta) * sin(phi) * oy + cos(theta) * oz) / 205e-1) AS INT) AS jw, CAST(least(50, floor(sqrt(power(xl + cos(theta) * cos(phi) * ox + cos(theta) * sin(phi) * oy - sin(theta) * oz, 2) + power(yl - sin(phi) * ox + cos(phi) * oy, 2)) / 10)) AS INT) AS jr FROM hits, ({SUB}) sub"
q("E16_profiles", lambda c: ev.profiles(c.some("event_number", "origin", "energy", "theta", "phi", "xl", "yl", "zl")), "event_number b axis bin ~e ~e_neg", f"SELECT event_number, b, 0 AS axis, jw AS bin, sum(v) AS e, coalesce(sum(v) FILTER (WHERE neg), 0) AS e_neg FROM ({KEYED}) k GROUP BY ALL UNION ALL SELECT event_number, b, 1 AS axis, jr AS bin, sum(v) AS e, coalesce(sum(v) FILTER (WHERE neg), 0) AS e_neg FROM ({KEYED}) k GROUP BY ALL")
q("E17_calibration", lambda c: ev.calibration(c.showers), "b ~sum_p ~sum_e ~c", "SELECT b, sum(p) AS sum_p, sum(e_own) AS sum_e, sum(p) / sum(e_own) AS c FROM sh GROUP BY b")
q("E18_reconstruct", lambda c: ev.reconstruct(c.showers), "event_number b ~e_reco ~residual", "SELECT event_number, b, e_own / 1e-2 AS e_reco, (e_own / 1e-2 - p) / p AS residual FROM sh")
q("E19_species", lambda c: ev.species(c.single), "$species n ~e n_primary ~share", "SELECT particle_type AS species, count(*) AS n, sum(energy) AS e, count(*) FILTER (WHERE is_secondary = 0) AS n_primary, sum(energy) / (SELECT sum(energy) FROM single) AS share FROM single GROUP BY 1 ORDER BY 3 DESC LIMIT 6")
ENTRY = "SELECT s.*, s.iz - m.entry AS own_layer, s.x - m.cx AS rx, s.y - m.cy AS ry, m.n_entry, m.entry = 0 AS front FROM single s JOIN (SELECT event_number, entry, sum(energy * x) / sum(energy) AS cx, sum(energy * y) / sum(energy) AS cy, count(*) AS n_entry FROM (SELECT *, min(iz) OVER (PARTITION BY event_number) AS entry FROM single) WHERE iz = entry GROUP BY event_number, entry) m USING (event_number)"
q("E20_to_shower_frame", lambda c: ev.to_shower_frame(c.single), "event_number cell_id own_layer n_entry ~rx ~ry", ENTRY)
q("E21_artifacts", lambda c: ev.artifacts(c.single), "n one_entry at_origin front ~one_entry_share", f"SELECT count(*) AS n, count(*) FILTER (WHERE n_entry = 1) AS one_entry, sum(o) AS at_origin, count(*) FILTER (WHERE front) AS front, count(*) FILTER (WHERE n_entry = 1) / CAST(count(*) AS DOUBLE) AS one_entry_share FROM (SELECT event_number, max(n_entry) AS n_entry, max(front) AS front, count(*) FILTER (WHERE abs(rx) < 1e-9 AND abs(ry) < 1e-9 AND own_layer = 0) AS o FROM ({ENTRY}) GROUP BY 1)")
q("E22_shower_axis", lambda c: ev.shower_axis(c.single), "~slope_x ~slope_y ~x0 ~y0", "SELECT regr_slope_x AS slope_x, regr_slope_y AS slope_y, (sx - regr_slope_x * sz) / sw AS x0, (sy - regr_slope_y * sz) / sw AS y0 FROM (SELECT *, (sw * szx - sz * sx) / (sw * szz - sz * sz) AS regr_slope_x, (sw * szy - sz * sy) / (sw * szz - sz * sz) AS regr_slope_y FROM (SELECT sum(w) AS sw, sum(w * z) AS sz, sum(w * z * z) AS szz, sum(w * cx) AS sx, sum(w * z * cx) AS szx, sum(w * cy) AS sy, sum(w * z * cy) AS szy FROM (SELECT z - 36624e-1 AS z, sum(energy) AS w, sum(energy * x) / sum(energy) AS cx, sum(energy * y) / sum(energy) AS cy FROM single GROUP BY z)))")
q("E23_sample10", lambda c: ev.sample10(c.hits), f"{HIT} ~energy", "SELECT * FROM hits WHERE (event_number * 7919 + cell_id) % 10 = 0")
