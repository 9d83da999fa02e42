"""Queries of the event-level panels, the estimators and the intervals."""

from pyspark.sql import functions as F

from ..functions import estimates as es
from ..functions import fits as ft
from ..operators import axes as ax
from ..operators import events as ev
from ..operators import filters as fl
from ..operators import models as md
from ..operators import panels as pn
from ..sources.shared import written
from .registry import q

SERIES = "SELECT event_number, b, d, p, bin, theta, 'truth' AS series, p AS value FROM sh UNION ALL SELECT event_number, b, d, p, bin, theta, 'model', energy_pred FROM sh UNION ALL SELECT event_number, b, d, p, bin, theta, 'deposit', e_own / 1e-2 FROM sh"
SLICE = "CASE WHEN d IS NULL THEN -1 WHEN d <= 50 THEN 0 WHEN d <= 100 THEN 1 WHEN d <= 150 THEN 2 WHEN d <= 200 THEN 3 ELSE 4 END"
GAUSS = "count(value) AS n, avg(value) AS mu, stddev_samp(value) AS s, stddev_pop(value) AS s0, median(value) AS median, CASE WHEN count(value) >= 20 THEN (quantile_cont(value, 75e-2) - quantile_cont(value, 25e-2)) / 1349e-3 END AS robust"
T = "(CASE WHEN n < 2 THEN NULL WHEN n <= 31 THEN list_extract([" + ", ".join(f"CAST({x} AS DOUBLE)" for x in es.T975) + "], CAST(n - 1 AS INT)) ELSE 1959963984540054e-15 + (pow(1959963984540054e-15, 3) + 1959963984540054e-15) / (4e0 * (n - 1)) + (5 * pow(1959963984540054e-15, 5) + 16 * pow(1959963984540054e-15, 3) + 3 * 1959963984540054e-15) / (96e0 * (n - 1) * (n - 1)) END)"
Z = "1959963984540054e-15"
RATIO = "sum(a) / sum(b) AS ratio, sqrt(greatest(0, sum(a * a) - 2 * sum(a) / sum(b) * sum(a * b) + pow(sum(a) / sum(b), 2) * sum(b * b)) * count(*) / nullif(count(*) - 1, 0)) / sum(b) AS se"


def table(c):
    return pn.feature_table(ev.features(ev.shape_sums(c.single)), c.singles)


def windows(c):
    return pn.resolution_windows(pn.energy_series(c.series_showers()))


q("V1_summary", lambda c: pn.summary(c.events), "n n_hits without_d ~e_dep ~mean_d ~median_d ~sd_d ~mean_e1 ~mean_e2 ~mean_cax ~mean_cby", "SELECT count(*) AS n, sum(n_hits) AS n_hits, count(*) - count(d) AS without_d, sum(e_dep) AS e_dep, avg(d) AS mean_d, median(d) AS median_d, stddev_samp(d) AS sd_d, avg(e1) AS mean_e1, avg(e2) AS mean_e2, avg(cax) AS mean_cax, avg(cby) AS mean_cby FROM ev")
q("V2_coherence", lambda c: pn.coherence(c.showers), "b n ~r ~theta", "SELECT b, count(*) AS n, sqrt(pow(avg(cos(phi)), 2) + pow(avg(sin(phi)), 2)) AS r, avg(theta) AS theta FROM sh GROUP BY b")
q("V3_pointing", lambda c: pn.pointing(c.showers), "b ~mean ~sd ~depth", "SELECT b, avg(o) AS mean, stddev_samp(o) AS sd, median(sqrt(cxt * cxt + cyt * cyt) / tan(theta)) AS depth FROM (SELECT *, atan2(sin(phi - atan2(cyt, cxt)), cos(phi - atan2(cyt, cxt))) AS o FROM sh) GROUP BY b")
q("V4_trajectories", lambda c: pn.trajectories(c.showers, 10), "event_number b ~theta ~phi ~cx", "SELECT * FROM sh WHERE event_number IN (SELECT DISTINCT event_number FROM sh ORDER BY 1 LIMIT 10)")
q("V5_window_axis", lambda c: pn.window_axis(c.showers, 20, 80), "b station n ~centre ~spread ~rayleigh_p", "SELECT b, station, n, entry + slope * w AS centre, sqrt(greatest(0, v + 2 * w * cov + w * w * vs)) AS spread, rayleigh_p FROM (SELECT b, count(*) AS n, avg(p0x) AS entry, var_samp(p0x) AS v, avg(t) AS slope, var_samp(t) AS vs, covar_samp(p0x, t) AS cov, exp(-count(*) * (pow(avg(cos(phi)), 2) + pow(avg(sin(phi)), 2))) AS rayleigh_p FROM (SELECT *, tan(theta) * cos(phi) AS t FROM sh WHERE p0x BETWEEN 20 AND 80) GROUP BY b), (SELECT station, station * 1875e-2 AS w FROM range(9) r(station)) r")
q("V6_ensemble_axes", lambda c: pn.ensemble_axes(c.showers), "b n ~slope ~sd ~lo ~hi", f"SELECT *, slope - {T} * sd / sqrt(n) AS lo, slope + {T} * sd / sqrt(n) AS hi FROM (SELECT b, count(*) AS n, avg(tan(theta) * cos(phi)) AS slope, stddev_samp(tan(theta) * cos(phi)) AS sd FROM sh GROUP BY b)")
q("V7_energy_by_d", lambda c: pn.energy_by_d(c.series_showers()), "slice $series n ~mu ~s ~median ~robust ~mu_lo", f"SELECT *, mu - {T} * s / sqrt(n) AS mu_lo FROM (SELECT {SLICE} AS slice, series, {GAUSS} FROM ({SERIES}) GROUP BY ALL)")
q("V8_energy_by_p", lambda c: pn.energy_by_p(c.showers), "bin $series n ~mu ~s ~median", f"SELECT bin, series, {GAUSS} FROM ({SERIES}) GROUP BY ALL")
q("V9_benchmarks", lambda c: pn.benchmarks(c.events), "~marker_a ~marker_b ~width", "SELECT avg(e1) AS marker_a, avg(e2) AS marker_b, 5e-2 AS width FROM ev")
q("V10_sampling", lambda c: pn.sampling(c.showers), "b n ~ratio ~se ~lo ~hi", f"SELECT *, ratio - {T} * se AS lo, ratio + {T} * se AS hi FROM (SELECT k AS b, count(*) AS n, {RATIO} FROM (SELECT b AS k, e_own AS a, p AS b FROM sh) GROUP BY k)")
q("V11_sampling_by_bin", lambda c: pn.sampling_by_bin(c.showers), "b bin n ~mu ~s ~ratio ~scale", "SELECT b, bin, count(*) AS n, avg(e_own / p) AS mu, stddev_samp(e_own / p) AS s, sum(e_own) / sum(p) AS ratio, sum(p) / sum(e_own) AS scale FROM sh GROUP BY ALL")
CHI = {end: f"(CASE WHEN n < 2 THEN NULL WHEN n <= 31 THEN list_extract([{', '.join(f'CAST({x!r} AS DOUBLE)' for x in es.chi2_table(p))}], CAST(n - 1 AS INT)) ELSE (n - 1) * pow(1 - 2 / (9e0 * (n - 1)) {sign} {Z} * sqrt(2 / (9e0 * (n - 1))), 3) END)" for end, p, sign in (("lo", 0.975, "+"), ("hi", 0.025, "-"))}
q("V12_resolution", lambda c: pn.resolution(c.showers), "b bin n ~mu ~s ~res ~s_lo ~s_hi ~sd_p", f"SELECT *, s / mu AS res, s * sqrt((n - 1) / {CHI['lo']}) AS s_lo, s * sqrt((n - 1) / {CHI['hi']}) AS s_hi FROM (SELECT b, bin, count(*) AS n, avg(e_own / 1e-2 / p) AS mu, stddev_samp(e_own / 1e-2 / p) AS s, stddev_samp(p) AS sd_p FROM sh GROUP BY ALL)")
WIN = f"SELECT series, bin, count(*) AS n, avg(1 / sqrt(p)) AS x, avg(r) AS mu, stddev_samp(r) AS s, median(r) AS median, median(abs(r - 1)) AS off, stddev_samp(r) / avg(r) AS kappa, CASE WHEN count(*) >= 20 AND median(r) > 0 THEN (quantile_cont(r, 75e-2) - quantile_cont(r, 25e-2)) / (1349e-3 * median(r)) END AS robust FROM (SELECT *, value / p AS r FROM ({SERIES})) GROUP BY ALL"
q("V13_resolution_windows", lambda c: windows(c), "$series bin n ~x ~mu ~s ~median ~off ~kappa ~robust", WIN)
q("V14_pooled_scale", lambda c: pn.pooled_scale(windows(c)), "$series ~scale", f"SELECT series, median(sqrt(n) * kappa) AS scale FROM ({WIN}) WHERE n >= 8 AND kappa IS NOT NULL GROUP BY series")
q("V15_anchors", lambda c: pn.anchors(windows(c)), "$series anchor bin", f"SELECT series, anchor, bin FROM ({WIN}), (VALUES (0, 25e-1), (1, 55e-1), (2, 105e-1)) a(anchor, nominal) WHERE n >= 15 QUALIFY row_number() OVER (PARTITION BY series, anchor ORDER BY round(abs(ln((bin + 5e-1) / nominal)), 9), bin) = 1")


def _fit_sql(rounds: int = 60) -> str:
    """Every form by its own sums, its weights taken again from the fitted value so often that it has settled."""
    err = "abs({0}) * sqrt(1e0 / (2 * (n - 1)) + {0} * {0} / n)"
    root = f"2 * sqrt(v) * {err.format('sqrt(v)')}"
    basis = "SELECT series, n, x, kappa, 'affine' AS form, x AS u, 1e0 AS o, kappa AS y, kappa AS v FROM w UNION ALL SELECT series, n, x, kappa, 'pinned', x, 0e0, kappa, kappa FROM w UNION ALL SELECT series, n, x, kappa, 'quadrature', x * x, 1e0, kappa * kappa, kappa * kappa FROM w"
    weight = f"pow(CASE WHEN form = 'quadrature' THEN {root} ELSE {err.format('v')} END, -2)"
    sums = f"count(*) AS n, sum(g) AS s, sum(g * u) AS su, sum(g * u * u) AS suu, sum(g * y) AS sy, sum(g * u * y) AS suy, sum(g * y * y) AS syy"
    line = "CASE WHEN form = 'pinned' THEN suy / suu ELSE (s * suy - su * sy) / (s * suu - su * su) END AS a, CASE WHEN form <> 'pinned' THEN (suu * sy - su * suy) / (s * suu - su * su) END AS b"
    one = lambda i, source: f"f{i} AS MATERIALIZED (SELECT *, {line} FROM (SELECT series, form, {sums} FROM (SELECT *, {weight} AS g FROM ({source})) GROUP BY ALL))"
    again = lambda i: f"SELECT p.* EXCLUDE (v), CASE WHEN f.a * u + coalesce(f.b, 0) > 0 THEN f.a * u + coalesce(f.b, 0) ELSE p.v END AS v FROM p JOIN f{i} f USING (series, form)"
    chain = ", ".join([one(0, "SELECT * FROM p"), *[one(i + 1, again(i)) for i in range(rounds)]])
    rest = "greatest(0, syy - 2 * a * suy + a * a * suu + CASE WHEN form = 'pinned' THEN 0 ELSE b * b * s - 2 * b * sy + 2 * a * b * su END)"
    return f"WITH w AS (SELECT * FROM ({WIN}) WHERE n >= 8 AND kappa > 1e-9), p AS MATERIALIZED ({basis}), {chain}, r AS (SELECT *, {rest} AS chi2, n - CASE WHEN form = 'pinned' THEN 1 ELSE 2 END AS ndf FROM f{rounds}), z AS (SELECT *, sqrt(greatest(1e0, chi2 / nullif(ndf, 0))) AS scale, CASE WHEN form = 'pinned' THEN suu ELSE (s * suu - su * su) / s END AS da, CASE WHEN form <> 'pinned' THEN (s * suu - su * su) / suu END AS db, CASE WHEN form <> 'pinned' THEN -su / (s * suu - su * su) END AS cab FROM r)"


FITTED = _fit_sql()
q("V16_fit_resolution", lambda c: ft.fit_windows(windows(c).filter("kappa > 1e-9")).withColumn("chi2_ndf", F.try_divide("chi2", "ndf")), "$series $form n ~a ~b ~se_a ~se_b ~rho ~chi2_ndf ndf ~scale misfit", f"{FITTED} SELECT *, chi2 / nullif(ndf, 0) AS chi2_ndf, scale / sqrt(da) AS se_a, scale / sqrt(db) AS se_b, cab * sqrt(da * db) AS rho, CASE WHEN scale > 5 THEN 1 ELSE 0 END AS misfit FROM z")
BAND_T = T.replace("n < 2", "ndf < 1").replace("n <= 31", "ndf <= 30").replace("n - 1", "ndf")
BAND = f"{FITTED} SELECT series, form, point, x, CASE WHEN form = 'quadrature' THEN sqrt(greatest(0, v)) ELSE v END AS y, CASE WHEN form = 'quadrature' THEN sqrt(greatest(0, v - h)) ELSE v - h END AS lo, CASE WHEN form = 'quadrature' THEN sqrt(greatest(0, v + h)) ELSE v + h END AS hi FROM (SELECT *, a * u + coalesce(b, 0) AS v, scale * CASE WHEN scale > 1 THEN {BAND_T} ELSE {Z} END * sqrt(greatest(0, u * u / da + coalesce(1 / db + 2 * u * cab, 0))) AS h FROM (SELECT z.*, point, 2e-1 + 2e-1 * point AS x, CASE WHEN form = 'quadrature' THEN pow(2e-1 + 2e-1 * point, 2) ELSE 2e-1 + 2e-1 * point END AS u FROM z, range(5) g(point)))"
q("V16_fit_bands", lambda c: ft.fit_bands(windows(c).filter("kappa > 1e-9")), "$series $form point ~x ~y ~lo ~hi", BAND)
q("V17_fit_noise", lambda c: ft.fit_windows(windows(c).filter("kappa > 1e-9"), ("noise",)), "$series n ~a ~b ~c ~se_a ~se_b ~se_c ~chi2 ndf ~p_value ~scale misfit")
q("V18_median_calibration", lambda c: pn.median_calibration(c.showers), "b ~c", "SELECT b, 1 / median(e_own / p) AS c FROM sh WHERE e_own > 0 GROUP BY b")
q("V19_dominant_species", lambda c: pn.dominant_species(c.singles), "$primary_type n ~share dominant", "SELECT primary_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, 0 AS dominant FROM sg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
QUANT = "SELECT 'x' AS quantity, xl AS c, energy FROM hits UNION ALL SELECT 'y', yl, energy FROM hits UNION ALL SELECT 'z', zl, energy FROM hits UNION ALL SELECT 'rho', sqrt(xl * xl + yl * yl), energy FROM hits UNION ALL SELECT 'e', energy, energy FROM hits"
q("V20_describe_hits", lambda c: pn.describe_hits(c.hits), "$quantity n ~mean ~s1 ~s0 ~lo ~q1 ~q2 ~q3 ~hi ~weighted", f"SELECT quantity, count(*) AS n, avg(c) AS mean, stddev_samp(c) AS s1, stddev_pop(c) AS s0, min(c) AS lo, quantile_cont(c, 25e-2) AS q1, median(c) AS q2, quantile_cont(c, 75e-2) AS q3, max(c) AS hi, sum(energy * c) / sum(energy) AS weighted FROM ({QUANT}) GROUP BY 1")
q("V21_weighted_quartiles", lambda c: pn.weighted_quartiles(c.hits), "~q1 ~q2 ~q3", "WITH s AS (SELECT *, sum(e) OVER (ORDER BY bin) AS upto, sum(e) OVER () AS total FROM (SELECT floor(xl) AS bin, sum(energy) AS e FROM hits GROUP BY 1)) SELECT arg_min(bin + (25e-2 * total - upto + e) / e, bin) FILTER (WHERE upto >= 25e-2 * total) AS q1, arg_min(bin + (5e-1 * total - upto + e) / e, bin) FILTER (WHERE upto >= 5e-1 * total) AS q2, arg_min(bin + (75e-2 * total - upto + e) / e, bin) FILTER (WHERE upto >= 75e-2 * total) AS q3 FROM s")
q("V22_selection_counts", lambda c: pn.selection_counts(c.showers), "events showers hits with_a", "SELECT count(DISTINCT event_number) AS events, count(*) AS showers, sum(n_own) AS hits, count(DISTINCT event_number) FILTER (WHERE b = 0) AS with_a FROM sh")
NEG = "SELECT event_number, CASE WHEN origin = 'A' THEN 0 ELSE 1 END AS sb, max(p) AS p, count(*) AS n, count(*) FILTER (WHERE zl < -1025e-2) AS nn, sum(energy) AS e, coalesce(sum(energy) FILTER (WHERE zl < -1025e-2), 0) AS en FROM hits GROUP BY ALL"
q("V24_affected", lambda c: pn.affected(c.hits), "n ~mean ~sd ~median", f"SELECT count(*) AS n, avg(f) AS mean, stddev_samp(f) AS sd, median(f) AS median FROM (SELECT CAST(nn AS DOUBLE) / n AS f FROM ({NEG})) WHERE f > 0")
q("V26_hit_uvw", lambda c: pn.hit_uvw(c.hits), "mb $axis bin n", "WITH o AS (SELECT ((i + 5e-1) / 2 - 5e-1) * 486e-1 AS ox, ((j + 5e-1) / 2 - 5e-1) * 505e-1 AS oy FROM range(2) a(i), range(2) b(j)) SELECT floor(p) AS mb, axis, floor(c / 20) AS bin, count(*) AS n FROM (SELECT p, 'u' AS axis, xl + ox AS c FROM hits, o UNION ALL SELECT p, 'v', yl + oy FROM hits, o UNION ALL SELECT p, 'w', zl FROM hits, o) GROUP BY ALL")
q("V27_hit_energy", lambda c: pn.hit_energy(c.hits), "mb bin n", "SELECT floor(p) AS mb, floor(log10(energy) * 100) AS bin, count(*) AS n FROM hits GROUP BY ALL")
HISTS = (("theta", "0.05", "0.55", 25), ("phi", "-3.0", "3.0", 24), ("p", "1.0", "20.0", 38))


def _hist_sql() -> str:
    one = lambda c, lo, hi, n: f"SELECT '{c}' AS quantity, bin AS mb, CASE WHEN {c} < CAST('{lo}' AS DOUBLE) THEN -1 WHEN {c} >= CAST('{hi}' AS DOUBLE) THEN {n} ELSE floor(({c} - CAST('{lo}' AS DOUBLE)) / ((CAST('{hi}' AS DOUBLE) - CAST('{lo}' AS DOUBLE)) / {n})) END AS \"at\", count(*) AS n, sum(n_own) AS hits FROM sh GROUP BY ALL"
    return " UNION ALL ".join(one(*h) for h in HISTS)


q("V28_shower_hist", lambda c: pn.shower_hists(c.showers, {n: (float(lo), float(hi), k) for n, lo, hi, k in HISTS}), "$quantity mb at n hits", _hist_sql())
q("V29_weighted_percentile", lambda c: pn.weighted_percentile(c.showers), "b ~median_p ~p90_theta", "SELECT b, median(p) AS median_p, quantile_cont(theta, 9e-1) AS p90_theta FROM (SELECT b, p, theta, unnest(range(n_own)) FROM sh) GROUP BY b")


def _moment_sql(source: str, cols: dict[str, str], keys: str = "") -> str:
    names = list(cols)
    inner = ", ".join(f"{v} AS v_{k}" for k, v in cols.items())
    sums = [f"sum(v_{n}) AS s_{n}" for n in names] + [f"sum(v_{a} * v_{b}) AS s_{a}{b}" for i, a in enumerate(names) for b in names[i:]]
    return f"SELECT g, count(*) AS n, {', '.join(sums)} FROM (SELECT event_number % 64 AS g, {inner} FROM {source}) GROUP BY g"


HM = _moment_sql("hits", {"x": "xl", "y": "yl", "z": "zl - 70", "e": "log10(energy) + 15e-1", "p": "p - 8", "t": "theta", "c": "cos(phi)", "s": "sin(phi)"})
EM = _moment_sql("sh", {"p": "p - 8", "t": "theta", "c": "cos(phi)", "s": "sin(phi)"})
#: Sums of squares in mm have 14 digits, more than two orders of summation agree in; means per hit do not grow with the data.
MEANS = "x y z e p t c s xx xy ze ep pt cs".split()
q("V30_hit_moments", lambda c: pn.hit_moments(c.hits).select("g", "n", *[(F.col(f"s_{m}") / F.col("n")).alias(f"m_{m}") for m in MEANS]), "g n " + " ".join(f"~m_{m}" for m in MEANS), f"SELECT g, n, {', '.join(f's_{m} / n AS m_{m}' for m in MEANS)} FROM ({HM})")
q("V31_event_moments", lambda c: pn.event_moments(c.showers), "g n ~s_p ~s_t ~s_c ~s_s ~s_pp ~s_pt ~s_pc ~s_cs", EM)
q("V31_event_moments_by_hits", lambda c: pn.event_moments(c.showers, True), "g n ~s_p ~s_t ~s_c ~s_pt", "SELECT event_number % 64 AS g, sum(n_own) AS n, sum(n_own * p) AS s_p, sum(n_own * theta) AS s_t, sum(n_own * cos(phi)) AS s_c, sum(n_own * p * theta) AS s_pt FROM sh GROUP BY 1")


def _jack_sql() -> str:
    from itertools import combinations

    rows = " UNION ALL ".join(f"SELECT g, '{a}{b}' AS pair, n, s_{a} AS a, s_{b} AS b, s_{a}{a} AS aa, s_{b}{b} AS bb, s_{a}{b} AS ab FROM m" for a, b in combinations("xyzept", 2))
    left = "(n * ab - a * b) / (sqrt(n * aa - a * a) * sqrt(n * bb - b * b))"
    minus = ", ".join(f"sum({c}) OVER w - {c} AS {c}" for c in ("n", "a", "b", "aa", "bb", "ab"))
    return f"WITH m AS ({HM}), l AS ({rows}), t AS (SELECT pair, {left} AS r, n FROM (SELECT pair, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(aa) AS aa, sum(bb) AS bb, sum(ab) AS ab FROM l GROUP BY pair)), z AS (SELECT pair, count(*) AS groups, sqrt((count(*) - 1) * var_pop(atanh({left}))) AS se FROM (SELECT pair, {minus} FROM l WINDOW w AS (PARTITION BY pair)) GROUP BY pair) SELECT t.pair, r, n, groups, se FROM t JOIN z USING (pair)"


q("V32_corr_matrix", lambda c: pn.corr_matrix(pn.hit_moments(c.hits)), "$pair ~r n groups ~se", _jack_sql())
q("V33_mardia", lambda c: pn.mardia(pn.event_moments(c.showers)), "~xc ~xs ~cs ~r", "SELECT *, sqrt((xc * xc + xs * xs - 2 * xc * xs * cs) / (1 - cs * cs)) AS r FROM (SELECT corr(p, cos(phi)) AS xc, corr(p, sin(phi)) AS xs, corr(cos(phi), sin(phi)) AS cs FROM sh)")
FT = "SELECT * FROM ft WHERE n > 1"
LONG = " UNION ALL ".join(f"SELECT label, '{n}' AS feature, {n} AS value FROM ft WHERE n > 1" for n in pn.LINEAR)
q("V34_feature_table", lambda c: table(c), "event_number label p_bin ~p ~width ~height ~depth ~mean_r ~weighted_r", FT)
q("V35_feature_describe", lambda c: pn.feature_describe(table(c)), "label $feature n ~mean ~s1 ~s0 ~lo ~q25 ~median ~q75 ~hi floored ~mean_lo ~mean_hi ~sd_lo ~sd_hi ~sd_se", f"SELECT *, mean - {T} * s1 / sqrt(n) AS mean_lo, mean + {T} * s1 / sqrt(n) AS mean_hi, s1 * sqrt((n - 1) / {CHI['lo']}) AS sd_lo, s1 * sqrt((n - 1) / {CHI['hi']}) AS sd_hi, s1 / sqrt(2e0 * (n - 1)) AS sd_se FROM (SELECT label, feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS s1, stddev_pop(value) AS s0, min(value) AS lo, quantile_cont(value, 25e-2) AS q25, median(value) AS median, quantile_cont(value, 75e-2) AS q75, max(value) AS hi, count(*) FILTER (WHERE value <= 1e-6) AS floored FROM ({LONG}) GROUP BY ALL)")


def _pairs_sql() -> str:
    from itertools import combinations

    return " UNION ALL ".join(f"SELECT label, '{a}:{b}' AS pair, {a} AS u, {b} AS v FROM ft WHERE n > 1 AND {a} > 1e-6 AND {b} > 1e-6" for a, b in combinations(pn.LINEAR, 2))


q("V36_feature_corr", lambda c: pn.feature_corr(table(c)), "label $pair ~r n ~lo ~hi", f"SELECT *, CASE WHEN n > 3 THEN tanh(atanh(least(1 - 1e-12, r)) - {Z} / sqrt(n - 3)) END AS lo, CASE WHEN n > 3 THEN tanh(atanh(least(1 - 1e-12, r)) + {Z} / sqrt(n - 3)) END AS hi FROM (SELECT label, pair, corr(u, v) AS r, count(*) AS n FROM ({_pairs_sql()}) GROUP BY ALL)")
q("V37_circ_corr", lambda c: pn.circ_corr(c.events, "phi_a", "phi_b"), "~r n", "SELECT sum(sin(phi_a - ma) * sin(phi_b - mb)) / sqrt(sum(pow(sin(phi_a - ma), 2)) * sum(pow(sin(phi_b - mb), 2))) AS r, count(*) AS n FROM ev, (SELECT atan2(avg(sin(phi_a)), avg(cos(phi_a))) AS ma, atan2(avg(sin(phi_b)), avg(cos(phi_b))) AS mb FROM ev)")
q("V38_feature_hist", lambda c: pn.feature_hist(table(c), "weighted_r"), "label bin n", "SELECT label, least(19, floor((weighted_r - lo) / ((hi - lo) / 20))) AS bin, count(*) AS n FROM ft, (SELECT min(weighted_r) AS lo, max(weighted_r) AS hi FROM ft WHERE n > 1) WHERE n > 1 GROUP BY ALL")
PLANNED = (*pn.LINEAR, "volume", "centroid_x", "n", "trans_depth_range")
LATTICES, SIGNED = {"n": 1.0, "trans_depth_range": None}, ("centroid_x",)


def planned_rows(c):
    ft = pn.feature_table(ev.features(ev.features(ev.shape_sums(c.single)), "t", "trans_"), c.singles)
    return written(pn.long_features(ft, PLANNED), "axis-rows")


def planned(rows):
    return ax.plan_axes(rows, LATTICES, SIGNED)


def counted(rows):
    return ax.planned_hist(rows, planned(rows))


def _plan_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT label, '{n}' AS feature, CAST({'greatest(max_zt - min_zt, 1e-6)' if n == 'trans_depth_range' else n} AS DOUBLE) AS value FROM ft WHERE n > 1" for n in PLANNED)
    return f"""lf AS MATERIALIZED ({rows}), sz AS (SELECT feature, label, count(*) AS n FROM lf GROUP BY ALL), mn AS (SELECT feature, coalesce(min(n) FILTER (WHERE n >= 15), 0) AS least FROM sz GROUP BY 1),
      st AS (SELECT feature, value FROM lf JOIN sz USING (feature, label) JOIN mn USING (feature) WHERE (sz.n >= 15 OR least = 0) AND (value > 1e-6 OR feature = 'centroid_x')),
      qt AS (SELECT feature, quantile_cont(value, 1e-2) AS p1, quantile_cont(value, 99e-2) AS p2, quantile_cont(log10(CASE WHEN value > 0 THEN value END), 1e-2) AS g1, quantile_cont(log10(CASE WHEN value > 0 THEN value END), 99e-2) AS g2 FROM st GROUP BY 1),
      sc AS (SELECT *, feature NOT IN ('n', 'trans_depth_range') AND coalesce(decades >= 1, FALSE) AS lg FROM (SELECT *, CASE WHEN feature <> 'centroid_x' AND p1 > 0 THEN log10(p2 / p1) END AS decades FROM qt)),
      en AS (SELECT *, CASE WHEN lg THEN g1 ELSE p1 END AS a, CASE WHEN lg THEN g2 ELSE p2 END AS z FROM sc),
      iv AS (SELECT *, (SELECT min(m * pow(10e0, floor(log10((z - a) / 12)))) FROM (VALUES (1e0), (2e0), (5e0), (10e0)) t(m) WHERE (z - a) / (m * pow(10e0, floor(log10((z - a) / 12)))) <= 12e0 * (1 + 1e-12)) AS iv FROM en),
      nr AS (SELECT *, floor(a / iv + 1e-9 * greatest(1, abs(a / iv))) * iv AS lo0, ceil(z / iv - 1e-9 * greatest(1, abs(z / iv))) * iv AS hi0, greatest(8, least(120, ceil(2 * pow(least, CAST(1 AS DOUBLE) / 3)))) AS b0 FROM iv JOIN mn USING (feature)),
      lt AS (SELECT 'n' AS feature, CAST(1 AS DOUBLE) AS step, min(value) AS anchor FROM lf WHERE feature = 'n' UNION ALL SELECT 'trans_depth_range', min(gap), min(v) FROM (SELECT v, v - lag(v) OVER (ORDER BY v) AS gap FROM (SELECT DISTINCT round(value, 6) AS v FROM lf WHERE feature = 'trans_depth_range' AND value > 1e-6))),
      w AS (SELECT *, greatest(1, ceil((hi0 - lo0) / b0 / step - 1e-9)) AS steps, anchor + (floor((lo0 - anchor) / step - 5e-1 + 1e-9) + 5e-1) * step AS first FROM nr LEFT JOIN lt USING (feature)),
      pl AS MATERIALIZED (SELECT feature, CASE WHEN lg THEN 'log' ELSE 'linear' END AS scale, coalesce(first, lo0) AS lo, coalesce(CASE WHEN step IS NOT NULL THEN steps * step END, (hi0 - lo0) / b0) AS width, CASE WHEN step IS NULL THEN b0 ELSE greatest(1, ceil((hi0 - first) / (steps * step) - 1e-9)) END AS bins,
        iv AS interval, decades, step, CASE WHEN step IS NOT NULL THEN steps END AS steps, CASE WHEN least = 0 THEN 1 ELSE 0 END AS provisional FROM w)"""


q("V38_plan_axes", lambda c: planned(planned_rows(c)), "$feature $scale ~lo ~width bins ~interval ~decades ~step steps provisional", f"WITH {_plan_sql()} SELECT * FROM pl")
q("V38_planned_hist", lambda c: counted(planned_rows(c)), "$feature label bin n", f"WITH {_plan_sql()} SELECT feature, label, CASE WHEN x IS NULL THEN -2 WHEN x < lo THEN -1 WHEN x > lo + bins * width THEN bins ELSE least(bins - 1, floor((x - lo) / width)) END AS bin, count(*) AS n FROM (SELECT *, CASE WHEN scale = 'log' THEN CASE WHEN value > 0 THEN log10(value) END ELSE value END AS x FROM lf JOIN pl USING (feature)) GROUP BY ALL")
q("V39_value_step", lambda c: pn.value_step(c.hits, "z"), "~step n", "SELECT min(gap) AS step, count(*) AS n FROM (SELECT v - lag(v) OVER (ORDER BY v) AS gap FROM (SELECT DISTINCT round(z, 6) AS v FROM hits))")
q("V40_hist2d", lambda c: pn.hist2d(c.singles, ("p", 0.0, 1.0), ("e_dep", 0.0, 0.05)), "bx by n", "SELECT floor(round(p, 9)) AS bx, floor(round(e_dep / CAST('0.05' AS DOUBLE), 9)) AS \"by\", count(*) AS n FROM sg GROUP BY ALL")
SEG = "accuracy ~precision ~recall ~f1 ~mae ~weighted_mae ~rmse"
SEGSQL = "sum(n_correct) / CAST(sum(n_hits) AS DOUBLE) AS accuracy, sum(n_tp) / CAST(sum(n_pred) AS DOUBLE) AS precision, sum(n_tp) / CAST(sum(n_true) AS DOUBLE) AS recall, 2e0 * sum(n_tp) / (sum(n_pred) + sum(n_true)) AS f1, sum(abs_err) / sum(n_hits) AS mae, sum(wabs_err) / sum(e_dep) AS weighted_mae, sqrt(sum(sq_err) / sum(n_hits)) AS rmse"
q("V41_seg_quality", lambda c: pn.seg_quality(c.events), f"n_hits ~{SEG}", f"SELECT sum(n_hits) AS n_hits, {SEGSQL} FROM ev")
q("V41_seg_quality_by_d", lambda c: pn.seg_quality(c.events.withColumn("slice", fl.d_slice(F.col("d"))), "slice"), f"slice n_hits ~{SEG}", f"SELECT {SLICE} AS slice, sum(n_hits) AS n_hits, {SEGSQL} FROM ev GROUP BY 1")
q("V43_perf_bins", lambda c: pn.perf_bins(c.showers), "b bin n ~rmse ~mae ~bias ~median_rel ~median_abs missing", "SELECT b, bin, count(*) AS n, sqrt(avg(pow(energy_pred - p, 2))) AS rmse, avg(abs(energy_pred - p)) AS mae, avg(energy_pred - p) AS bias, median((energy_pred - p) / p) AS median_rel, median(abs(energy_pred - p)) AS median_abs, 0 AS missing FROM sh GROUP BY ALL")
q("V44_pred_density", lambda c: pn.pred_density(c.showers), "b pb tb n", "SELECT b, CASE WHEN energy_pred >= 20 THEN 20 ELSE floor(energy_pred) END AS pb, CASE WHEN p >= 20 THEN 20 ELSE floor(p) END AS tb, count(*) AS n FROM sh GROUP BY ALL")
q("V45_residual_hist", lambda c: pn.residual_hist(c.showers), "bin n", "WITH r AS (SELECT (energy_pred - p) / p AS r FROM sh), q AS (SELECT quantile_cont(r, 1e-2) AS lo, quantile_cont(r, 99e-2) AS hi, 2 * (quantile_cont(r, 75e-2) - quantile_cont(r, 25e-2)) / pow(count(*), 1 / 3e0) AS w FROM r) SELECT floor((r - lo) / w + 1e-9) AS bin, count(*) AS n FROM r, q WHERE r BETWEEN lo AND hi GROUP BY 1")
WILSON = f"(k / CAST(n AS DOUBLE) + {Z} * {Z} / (2e0 * n)) / (1 + {Z} * {Z} / n) {{s}} {Z} * sqrt(k / CAST(n AS DOUBLE) * (1 - k / CAST(n AS DOUBLE)) / n + {Z} * {Z} / (4e0 * n * n)) / (1 + {Z} * {Z} / n)"
q("V47_primaries", lambda c: pn.primaries(ev.events_single(c.single_source)), "p_bin n k ~lo ~hi", f"SELECT *, {WILSON.format(s='-')} AS lo, {WILSON.format(s='+')} AS hi FROM (SELECT p_bin, count(*) AS n, count(*) FILTER (WHERE n_primary = 0) AS k FROM sg GROUP BY 1)")
q("V48_primary_counts", lambda c: pn.primary_counts(c.singles), "bucket n", "SELECT least(n_primary, 10) AS bucket, count(*) AS n FROM sg GROUP BY 1")
q("V49_candidates", lambda c: pn.candidates(c.events), "selected unplaceable pool matching both", "SELECT count(*) AS selected, count(*) - count(d) AS unplaceable, count(*) FILTER (WHERE d IS NOT NULL AND n_hits >= 3) AS pool, count(*) FILTER (WHERE e1 BETWEEN 5 AND 10) + count(*) FILTER (WHERE e2 BETWEEN 5 AND 10) AS matching, count(*) FILTER (WHERE e1 BETWEEN 5 AND 10 AND e2 BETWEEN 5 AND 10) AS \"both\" FROM ev")
q("V50_membership", lambda c: pn.membership(c.events, 100), "rank size before after", "SELECT count(*) FILTER (WHERE event_number <= 100) AS rank, count(*) AS size, max(event_number) FILTER (WHERE event_number < 100) AS before, min(event_number) FILTER (WHERE event_number > 100) AS after FROM ev WHERE d IS NOT NULL AND n_hits >= 3")
TILTED = "SELECT * FROM ev WHERE d IS NOT NULL AND n_hits > (SELECT avg(n_hits) FROM ev WHERE d IS NOT NULL) ORDER BY round(greatest(theta_a, theta_b), 9) DESC, event_number LIMIT 20"
q("V51_pick_tilted", lambda c: pn.pick_tilted(c.events, seed=3), "event_number n_hits ~theta drawn", f"SELECT event_number, n_hits, greatest(theta_a, theta_b) AS theta, CASE WHEN row_number() OVER (ORDER BY (event_number * 7919 + 3 * 104729) % 1000003, event_number) = 1 THEN 1 ELSE 0 END AS drawn FROM ({TILTED})")
q("V52_pick_densest", lambda c: pn.pick_densest(c.events, 5), "event_number n_hits", "SELECT * FROM ev ORDER BY n_hits DESC, event_number LIMIT 5")
q("V53_pick_uniform", lambda c: pn.pick_uniform(c.events, 3, 17), "event_number n_hits", "SELECT * FROM (SELECT event_number, n_hits, row_number() OVER (ORDER BY (event_number * 7919 + 3 * 104729) % 1000003, event_number) AS k, count(*) OVER () AS n FROM ev WHERE d IS NOT NULL AND n_hits >= 3) WHERE k = 17 % n + 1")
q("V54_resolution_inputs", lambda c: pn.resolution_inputs(c.showers), "event_number b $series bin ~ratio", f"SELECT *, value / p AS ratio FROM ({SERIES}) WHERE p > 0")
q("V55_p_marker", lambda c: pn.p_marker(c.showers), "bin ~mean ~sd ~lo ~hi", "SELECT bin, avg(p) AS mean, stddev_samp(p) AS sd, min(p) AS lo, max(p) AS hi FROM sh GROUP BY bin")
HELD = "(event_number * 7919) % 1000003 % 5 = 0"
held = lambda c: md.split(c.series_showers()).filter("holdout = 1")
q("V56_holdout_perf", lambda c: pn.perf_bins(held(c)), "b bin n ~rmse ~mae ~bias", f"SELECT b, bin, count(*) AS n, sqrt(avg(pow(energy_pred - p, 2))) AS rmse, avg(abs(energy_pred - p)) AS mae, avg(energy_pred - p) AS bias FROM sh WHERE {HELD} GROUP BY ALL")
q("V56_holdout_density", lambda c: pn.pred_density(held(c)), "b pb tb n", f"SELECT b, CASE WHEN energy_pred >= 20 THEN 20 ELSE floor(energy_pred) END AS pb, CASE WHEN p >= 20 THEN 20 ELSE floor(p) END AS tb, count(*) AS n FROM sh WHERE {HELD} GROUP BY ALL")

# --- estimators ---------------------------------------------------------------------------------------
PR = "SELECT b, bin, count(*) AS n, avg(p) AS mean, stddev_samp(p) AS sd FROM sh GROUP BY ALL"


def per_bin(c):
    return c.showers.groupBy("b", "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.stddev_samp("p").alias("sd"))


def two(df, lo_hi):
    return df.withColumns({"lo": lo_hi[0], "hi": lo_hi[1]})


q("T1_t_interval", lambda c: two(per_bin(c), es.t_interval(F.col("mean"), F.col("sd"), F.col("n"))), "b bin n ~lo ~hi", f"SELECT *, mean - {T} * sd / sqrt(n) AS lo, mean + {T} * sd / sqrt(n) AS hi FROM ({PR})")
q("T2_chi2_interval", lambda c: two(per_bin(c), es.chi2_interval(F.col("sd"), F.col("n"))), "b bin n ~lo ~hi", f"SELECT *, sd * sqrt((n - 1) / {CHI['lo']}) AS lo, sd * sqrt((n - 1) / {CHI['hi']}) AS hi FROM ({PR})")
q("T3_c4", lambda c: per_bin(c).withColumn("c4", es.c4(F.col("n"))), "b bin n ~c4", f"SELECT *, CASE WHEN n < 2 THEN NULL WHEN n <= 30 THEN sqrt(2e0 / (n - 1)) * exp(lgamma(n / 2e0) - lgamma((n - 1) / 2e0)) ELSE 1 - 1 / (4e0 * n) - 7 / (32e0 * n * n) END AS c4 FROM ({PR})")
q("T4_gauss", lambda c: es.gauss(pn.energy_series(c.showers), ["series", "bin"], "value"), "$series bin n ~mu ~s ~s0 ~robust ~se ~resolution", f"SELECT *, CASE WHEN n >= 2 THEN s / sqrt(n) END AS se, s / mu AS resolution FROM (SELECT series, bin, {GAUSS} FROM ({SERIES}) GROUP BY ALL)")


def _core_sql() -> str:
    steps = ["v AS MATERIALIZED (SELECT b, e_own / 1e-2 / p AS v FROM sh)", "m0 AS MATERIALIZED (SELECT *, n AS k, 0 AS rounds, n >= 15 AND s > 0 AS o FROM (SELECT b, count(*) AS n, avg(v) AS mu, stddev_samp(v) AS s FROM v GROUP BY b))"]
    for i in range(1, 17):
        inner = f"SELECT v.b, count(*) AS ck, avg(v) AS cm, stddev_samp(v) AS cs FROM v JOIN m{i - 1} m ON v.b = m.b AND o AND v BETWEEN mu - 25e-1 * s AND mu + 25e-1 * s GROUP BY v.b"
        take = ", ".join(f"CASE WHEN go THEN {new} ELSE {old} END AS {old}" for new, old in (("cm", "mu"), ("cs", "s"), ("ck", "k")))
        steps.append(f"m{i} AS MATERIALIZED (SELECT b, n, {take}, rounds + CASE WHEN go THEN 1 ELSE 0 END AS rounds, go AND abs(cs - s) > 1e-7 * greatest(s, 1e-12) AS o FROM (SELECT m.*, ck, cm, cs, coalesce(o AND ck >= 15 AND cs > 0, FALSE) AS go FROM m{i - 1} m LEFT JOIN ({inner}) c ON m.b = c.b))")
    return f"WITH {', '.join(steps)} SELECT b, k AS n, mu, CASE WHEN k < n THEN s / 9365574133e-10 ELSE s END AS s, rounds, CASE WHEN k < n THEN 1 ELSE 0 END AS cut FROM m16"


q("T5_core_refit", lambda c: es.core_refit(c.showers.withColumn("v", F.col("e_own") / 0.01 / F.col("p")), ["b"], "v"), "b n ~mu ~s rounds cut", _core_sql())
q("T6_ratio_ci", lambda c: es.ratio_ci(c.showers, ["b", "bin"], F.col("e_own"), F.col("p")), "b bin n ~ratio ~se", f"SELECT k AS b, bin, count(*) AS n, {RATIO} FROM (SELECT b AS k, bin, e_own AS a, p AS b FROM sh) GROUP BY ALL")
q("T7_wilson", lambda c: two(c.events.groupBy(F.floor("e1").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("n_ab") > 0).alias("k")), es.wilson(F.col("k"), F.col("n"))), "bin n k ~lo ~hi", f"SELECT *, {WILSON.format(s='-')} AS lo, {WILSON.format(s='+')} AS hi FROM (SELECT floor(e1) AS bin, count(*) AS n, count(*) FILTER (WHERE n_ab > 0) AS k FROM ev GROUP BY 1)")
q("T8_fisher_ci", lambda c: two(c.showers.groupBy("b").agg(F.corr("p", "e_own").alias("r"), F.count("*").alias("n")), es.fisher_ci(F.col("r"), F.col("n"))), "b n ~r ~lo ~hi", f"SELECT *, tanh(atanh(r) - {Z} / sqrt(n - 3)) AS lo, tanh(atanh(r) + {Z} / sqrt(n - 3)) AS hi FROM (SELECT b, corr(p, e_own) AS r, count(*) AS n FROM sh GROUP BY b)")
q("T9_mae_rmse", lambda c: es.mae_rmse(c.showers, ["b"], F.col("energy_pred") - F.col("p")), "b n ~mae ~mae_lo ~mae_hi ~rmse ~rmse_lo ~rmse_hi ~bias", f"SELECT *, mae - {T} * sa / sqrt(n) AS mae_lo, mae + {T} * sa / sqrt(n) AS mae_hi, sqrt(mse) AS rmse, sqrt(greatest(0, mse - {T} * sq / sqrt(n))) AS rmse_lo, sqrt(mse + {T} * sq / sqrt(n)) AS rmse_hi FROM (SELECT b, count(*) AS n, avg(abs(e)) AS mae, stddev_samp(abs(e)) AS sa, avg(e * e) AS mse, stddev_samp(e * e) AS sq, avg(e) AS bias FROM (SELECT b, energy_pred - p AS e FROM sh) GROUP BY b)")
q("T10_bootstrap", lambda c: es.bootstrap(c.showers, ["b"], "p", F.col("energy_pred") - F.col("p")), "b n n_rmse ~se ~lo ~hi ~width_se ~width_lo ~width_hi ~rmse_se ~rmse_lo ~rmse_hi")
# The rank by summing the binomial's chances over the groups' own sizes.
RANKS = "SELECT n, greatest(1, count(*) FILTER (WHERE below <= 25e-3)) AS j FROM (SELECT n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) OVER (PARTITION BY n ORDER BY k) AS below FROM (SELECT n, unnest(range(n + 1)) AS k FROM (SELECT DISTINCT n FROM r))) GROUP BY n"
q("T11_median_order_ci", lambda c: es.median_order_ci(c.showers, ["b", "bin"], "e_own"), "b bin n ~lo ~hi", f"WITH r AS (SELECT b, bin, e_own, row_number() OVER (PARTITION BY b, bin ORDER BY e_own) AS k, count(*) OVER (PARTITION BY b, bin) AS n FROM sh), ranks AS ({RANKS}) SELECT b, bin, n, max(e_own) FILTER (WHERE k = CASE WHEN n <= 1000 THEN j ELSE floor((n + 1 - {Z} * sqrt(n)) / 2) END) AS lo, max(e_own) FILTER (WHERE k = n + 1 - CASE WHEN n <= 1000 THEN j ELSE floor((n + 1 - {Z} * sqrt(n)) / 2) END) AS hi FROM r JOIN ranks USING (n) WHERE n >= 6 GROUP BY ALL")
q("T12_robust_width", lambda c: es.robust_width(c.showers.withColumn("v", F.col("e_own") / F.col("p")), ["b"], "v"), "b n ~median ~sigma ~width ~tail", "WITH m AS (SELECT b, median(v) AS median, (quantile_cont(v, 75e-2) - quantile_cont(v, 25e-2)) / 1349e-3 AS sigma, count(*) AS n FROM (SELECT b, e_own / p AS v FROM sh) GROUP BY b) SELECT m.b, n, median, sigma, CASE WHEN n >= 20 AND median > 0 THEN sigma / median END AS width, CASE WHEN n >= 300 AND sigma > 0 THEN far / CAST(n AS DOUBLE) END AS tail FROM m JOIN (SELECT sh.b, count(*) FILTER (WHERE abs(e_own / p - median) > 3 * sigma) AS far FROM m JOIN sh ON m.b = sh.b GROUP BY sh.b) k ON m.b = k.b")
q("T13_circular", lambda c: es.circular(c.showers, ["b"], "phi"), "b n ~c ~s ~mean ~r ~sd ~rayleigh_p", "SELECT *, atan2(s, c) AS mean, sqrt(c * c + s * s) / n AS r, sqrt(-2 * ln(sqrt(c * c + s * s) / n)) AS sd, CASE WHEN n >= 2 THEN exp(-(c * c + s * s) / n) END AS rayleigh_p FROM (SELECT b, count(*) AS n, sum(cos(phi)) AS c, sum(sin(phi)) AS s FROM sh GROUP BY b)")
q("T14_clip_range", lambda c: es.clip_range(c.showers, ["b"], "e_own"), "b ~lo ~hi below above n", "WITH m AS (SELECT b, quantile_cont(e_own, 1e-2) AS lo, quantile_cont(e_own, 99e-2) AS hi FROM sh GROUP BY b) SELECT b, lo, hi, count(*) FILTER (WHERE e_own < lo) AS below, count(*) FILTER (WHERE e_own > hi) AS above, count(*) AS n FROM sh JOIN m USING (b) GROUP BY ALL")
q("T15_histogram", lambda c: es.histogram(c.showers, ["b"], "p", 0.0, 16.0, 32), "b bin n ~density", "SELECT *, CASE WHEN bin BETWEEN 0 AND 31 THEN n / (sum(n) FILTER (WHERE bin BETWEEN 0 AND 31) OVER (PARTITION BY b) * 5e-1) END AS density FROM (SELECT b, CASE WHEN p > 16 THEN 32 ELSE least(31, floor(p / 5e-1)) END AS bin, count(*) AS n FROM sh GROUP BY ALL)")
q("T16_band", lambda c: es.band(c.showers, ["b"], "energy_pred", "p", 4.0, 8.0), "b n ~response ~resolution", "SELECT b, count(*) AS n, avg(energy_pred / p) AS response, CASE WHEN count(*) >= 10 THEN stddev_samp(energy_pred / p) / avg(energy_pred / p) END AS resolution FROM sh WHERE p BETWEEN 4 AND 8 GROUP BY b")
q("T17_kde", lambda c: es.kde(c.showers, ["b"], "p", 0.0, 20.0), "b point ~at ~density", """WITH h0 AS (SELECT b, count(*) AS total, 9e-1 * CASE WHEN quantile_cont(p, 75e-2) > quantile_cont(p, 25e-2) THEN least(stddev_samp(p), (quantile_cont(p, 75e-2) - quantile_cont(p, 25e-2)) / 1349e-3) ELSE stddev_samp(p) END * pow(count(*), -2e-1) AS h FROM sh GROUP BY b),
  g AS (SELECT *, (20 + 8 * h) / (m - 1) AS d, -4 * h AS g0 FROM (SELECT *, least(8192, greatest(256, ceil((20 + 8 * h) / (h / 4)) + 1)) AS m FROM h0 WHERE total >= 8 AND h > 0)),
  t AS (SELECT sh.b, (p - g0) / g.d AS t, m FROM sh JOIN g USING (b) WHERE (p - g0) / g.d BETWEEN 0 AND m - 1),
  n AS (SELECT b, node, sum(w) AS w FROM (SELECT b, least(floor(t), m - 2) AS node, 1 - t + least(floor(t), m - 2) AS w FROM t UNION ALL SELECT b, least(floor(t), m - 2) + 1, t - least(floor(t), m - 2) FROM t) GROUP BY ALL),
  x AS (SELECT b, point, loc, h, d, total, least(floor((loc - g0) / d), m - 2) AS k, (loc - g0) / d - least(floor((loc - g0) / d), m - 2) AS a FROM g, (SELECT point, point * 20e0 / 159 AS loc FROM range(160) r(point))),
  s AS (SELECT x.*, k - node AS j, w FROM x JOIN n USING (b))
  SELECT b, point, loc AS "at", sum(w * ((1 - a) * CASE WHEN abs(j) <= ceil(4 * h / d) THEN exp(-5e-1 * pow(j * d / h, 2)) ELSE 0 END + a * CASE WHEN abs(j + 1) <= ceil(4 * h / d) THEN exp(-5e-1 * pow((j + 1) * d / h, 2)) ELSE 0 END)) / (any_value(h) * any_value(total) * sqrt(2 * pi())) AS density FROM s GROUP BY b, point, loc""")
