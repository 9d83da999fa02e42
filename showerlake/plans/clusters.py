"""Queries of the statistics over events as clusters, with the SQL that each is held against."""

from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import events as ev
from ..operators import filters as fl
from ..operators import panels as pn
from .base import KEYED
from .panels import CHI, NEG, SLICE, WILSON, T, Z
from .registry import q

RATIO = "sum(a) / nullif(sum(b), 0) AS value, sqrt(greatest(0, sum(a * a) - 2 * sum(a) / nullif(sum(b), 0) * sum(a * b) + pow(sum(a) / nullif(sum(b), 0), 2) * sum(b * b)) * count(*) / nullif(count(*) - 1, 0)) / nullif(sum(b), 0) AS se"


def _seg_sql() -> str:
    each = f"SELECT *, 'all' AS slice FROM ev UNION ALL SELECT *, CAST({SLICE} AS VARCHAR) FROM ev WHERE d IS NOT NULL"
    cards = cl.SEG_CARDS | {"rmse": ("sq_err", "n_hits")}
    long = " UNION ALL ".join(f"SELECT slice, '{k}' AS card, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM each_slice" for k, (a, b) in cards.items())
    ends = f"SELECT *, value - {T} * se AS low, value + {T} * se AS high FROM (SELECT slice, card, count(*) AS n, {RATIO} FROM ({long}) GROUP BY ALL)"
    pick = lambda plain, root: f"CASE WHEN card = 'rmse' THEN {root} ELSE {plain} END"
    return f"""WITH each_slice AS ({each}) SELECT slice, card, n, {pick('value', 'sqrt(value)')} AS value, {pick('se', 'se / (2 * sqrt(value))')} AS se,
      CASE WHEN low IS NOT NULL THEN {pick('greatest(0, low)', 'sqrt(greatest(0, low))')} END AS lo, CASE WHEN high IS NOT NULL THEN {pick('least(1, high)', 'sqrt(high)')} END AS hi FROM ({ends})"""


q("V41_seg_cards", lambda c: cl.seg_cards(c.events), "$slice $card n ~value ~se ~lo ~hi", _seg_sql())


def _neg_sql() -> str:
    split = "CASE WHEN p < 1 THEN 'low' WHEN p > 10 THEN 'high' ELSE 'mid' END"
    each = f"SELECT 'all' AS split, * FROM ({NEG}) UNION ALL SELECT {split}, * FROM ({NEG})"
    events = f"SELECT split, event_number, count(*) AS k, count(*) FILTER (WHERE nn > 0) AS k_any, CAST(sum(n) AS DOUBLE) AS hits, CAST(sum(nn) AS DOUBLE) AS hn, sum(e) AS e, sum(en) AS en FROM ({each}) GROUP BY ALL"
    one = lambda name, a, b: f"SELECT split, '{name}' AS what, {a} AS a, {b} AS b FROM each_event"
    shares = f"SELECT split, what, count(*) AS n, {RATIO} FROM ({one('hit', 'hn', 'hits')} UNION ALL {one('energy', 'en', 'e')}) GROUP BY ALL"
    col = lambda name, what: f"max({what}) FILTER (WHERE what = '{name}')"
    wide = ", ".join(f"{col(k, 'value')} AS {k}_share, greatest(0, {col(k, f'value - {T} * se')}) AS {k}_share_lo, least(1, {col(k, f'value + {T} * se')}) AS {k}_share_hi" for k in ("hit", "energy"))
    counts = "SELECT split, count(*) AS n, sum(k) AS showers, sum(k_any) AS showers_any, count(*) FILTER (WHERE hn > 0) AS k FROM each_event GROUP BY split"
    return f"WITH each_event AS ({events}), shares AS (SELECT split, {wide} FROM ({shares}) GROUP BY split) SELECT *, k AS events_any, {WILSON.format(s='-')} AS any_lo, {WILSON.format(s='+')} AS any_hi FROM ({counts}) JOIN shares USING (split)"


q("V23_negative_depth", lambda c: cl.negative_depth(c.hits), "$split n showers showers_any events_any ~any_lo ~any_hi ~hit_share ~hit_share_lo ~hit_share_hi ~energy_share ~energy_share_lo ~energy_share_hi", _neg_sql())


def _curves_sql(drop: bool) -> str:
    one = lambda axis, j: f"SELECT event_number, b, {axis} AS axis, {j} AS bin, sum(v) AS e, coalesce(sum(v) FILTER (WHERE neg), 0) AS en FROM k GROUP BY ALL"
    lost = "SELECT sh.event_number, sh.b, e_own, e_own - coalesce(en, 0) AS norm FROM sh LEFT JOIN (SELECT event_number, b, sum(en) AS en FROM pr WHERE axis = 0 GROUP BY ALL) g USING (event_number, b)" if drop else "SELECT event_number, b, e_own, e_own AS norm FROM sh"
    e = "e - en" if drop else "e"
    t = T.replace("n < 2", "g < 2").replace("n <= 31", "g <= 31").replace("n - 1", "g - 1")
    return f"""WITH k AS MATERIALIZED ({KEYED}), pr AS MATERIALIZED ({one(0, 'jw')} UNION ALL {one(1, 'jr')}), s AS (SELECT * FROM ({lost}) WHERE norm > 1e-12 * e_own),
      w AS (SELECT event_number, CAST(count(*) AS DOUBLE) AS m, sum(norm) AS den FROM s GROUP BY 1), tot AS (SELECT sum(m) AS n, CAST(count(*) AS DOUBLE) AS g, sum(m * m) AS m2, sum(den) AS allden, sum(den * den) AS den2 FROM w),
      u AS (SELECT event_number, axis, bin, sum({e}) AS num, sum(({e}) / norm) AS c, sum(pow(({e}) / norm, 2)) AS qq FROM (SELECT * FROM pr UNION ALL SELECT event_number, b, 2, layer, e, 0 FROM lay) JOIN s USING (event_number, b) GROUP BY ALL),
      z AS (SELECT axis, bin, sum(num) AS sn, sum(num * num) AS snn, sum(num * den) AS snd, sum(c) AS sc, sum(qq) AS sq, sum(c * c) AS scc, sum(m * c) AS smc FROM u JOIN w USING (event_number) GROUP BY ALL),
      y AS (SELECT *, sc / n AS mean, sn / allden AS pooled FROM z, tot),
      x AS (SELECT *, sqrt(greatest(0, (sq - n * mean * mean) / (n - 1))) AS sd, {t} * sqrt(g / (g - 1) * greatest(0, scc - 2 * mean * smc + mean * mean * m2)) / n AS h, {t} * sqrt(g / (g - 1) * greatest(0, snn - 2 * pooled * snd + pooled * pooled * den2)) / allden AS ph FROM y)
      SELECT axis, bin, mean, sd, mean - h AS lo, mean + h AS hi, pooled, pooled - ph AS pooled_lo, pooled + ph AS pooled_hi FROM x"""


CURVES = "axis bin ~mean ~sd ~lo ~hi ~pooled ~pooled_lo ~pooled_hi"
def curves(c, drop_negative=False):
    """Profiles, showers and layers of the hits, which are dealt by event once for all of them."""
    hits = c.by_event("origin", "energy", "theta", "phi", "xl", "yl", "zl", "xt", "yt", "zt")
    lost = F.sum(F.when(F.col("zl") < ev.NEGATIVE_DEPTH, F.col("energy")).otherwise(0.0))
    own = hits.groupBy("event_number", fl.own_shower(F.col("origin")).alias("b")).agg(F.sum("energy").alias("e_own"), lost.alias("lost"))
    return cl.profile_curves(ev.profiles(hits), own, ev.layers(hits), drop_negative)


q("V25_profile_curves", curves, CURVES, _curves_sql(False))
q("V25_curves_without_negative", lambda c: curves(c, True), CURVES, _curves_sql(True))

SHOWER_LINEAR = ("p", "theta", "e_own", "n_own")


def _mardia_sql(rows: str) -> str:
    """From rows of key, event_number, x and a: each group is left out by a join, and the correlations are taken anew."""
    r = "CASE WHEN 1 - abs(cs) > 1e-9 THEN sqrt(least(1, greatest(0, (xc * xc + xs * xs - 2 * xc * xs * cs) / (1 - cs * cs)))) ELSE least(1, coalesce(abs(xc), abs(xs))) END"
    three = "corr(x, cos(a)) AS xc, corr(x, sin(a)) AS xs, corr(cos(a), sin(a)) AS cs"
    return f"""WITH r AS MATERIALIZED ({rows}), g AS (SELECT DISTINCT key, event_number % 64 AS g FROM r),
      t AS (SELECT key, n, azimuths, {r} AS r FROM (SELECT key, count(*) AS n, count(DISTINCT round(a, 9)) AS azimuths, {three} FROM r GROUP BY key)),
      j AS (SELECT key, count(*) AS groups, sqrt((count(*) - 1) * var_pop(r)) AS se FROM (SELECT key, {r} AS r FROM (SELECT g.key, g.g, {three} FROM g JOIN r ON r.key = g.key AND r.event_number % 64 <> g.g GROUP BY g.key, g.g)) GROUP BY key)
      SELECT *, CASE WHEN azimuths >= 8 THEN r END AS r, CASE WHEN azimuths >= 8 AND groups >= 5 THEN se END AS se, CASE WHEN n >= 4 THEN 2e0 / (n - 1) END AS null_r2 FROM (SELECT key, n, azimuths, t.r, se, groups FROM t JOIN j USING (key))""".replace("SELECT *, CASE WHEN azimuths", "SELECT key, n, azimuths, groups, CASE WHEN azimuths", 1)


def by_variable(df, names, *keep):
    rows = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).cast("double").alias("x")) for n in names])
    return df.select("event_number", *keep, F.inline(rows))


q("V33_mardia_jackknife", lambda c: cl.circular_linear(by_variable(c.showers, SHOWER_LINEAR, "phi"), ["variable"], F.col("x"), F.col("phi")).withColumnRenamed("variable", "key"), "$key n azimuths ~r ~se ~null_r2", _mardia_sql(" UNION ALL ".join(f"SELECT '{n}' AS key, event_number, CAST({n} AS DOUBLE) AS x, phi AS a FROM sh" for n in SHOWER_LINEAR)))


def angled(c):
    """The feature table with both azimuths of a shower: the mean of the hits' and the direction of their sum."""
    return pn.feature_table(ev.circular_of_sums(ev.features(ev.shape_sums(c.single))), c.singles).withColumnRenamed("circ_mean", "avg_phi_circ")


ANGLES = {"avg_phi": "avg_phi", "avg_phi_circ": "atan2(sum_s_l, sum_c_l)"}
FTA = "SELECT * FROM ft WHERE n > 1"


def angle_cells(c):
    ft = angled(c)
    rows = [F.struct(F.concat(F.col("label"), F.lit(f":{n}:{a}")).alias("key"), F.col(n).alias("x"), F.col(a).alias("a")) for n in pn.LINEAR for a in ANGLES]
    return cl.circular_linear(ft.select("event_number", F.inline(F.array(*rows))).filter("x > 1e-6"), ["key"], F.col("x"), F.col("a"))


q("V36_angle_cells", angle_cells, "$key n azimuths ~r ~se ~null_r2", _mardia_sql(" UNION ALL ".join(f"SELECT label || ':{n}:{a}' AS key, event_number, {n} AS x, {sql} AS a FROM ({FTA}) WHERE {n} > 1e-6" for n in pn.LINEAR for a, sql in ANGLES.items())))


def _circ_sql() -> str:
    r = "sum(sin(a - ma) * sin(b - mb)) / sqrt(sum(pow(sin(a - ma), 2)) * sum(pow(sin(b - mb), 2)))"
    means = "atan2(avg(sin(a)), avg(cos(a))) AS ma, atan2(avg(sin(b)), avg(cos(b))) AS mb"
    t = T.replace("n < 2", "groups < 2").replace("n <= 31", "groups <= 31").replace("n - 1", "groups - 1")
    return f"""WITH r AS MATERIALIZED (SELECT label, event_number, {ANGLES['avg_phi']} AS a, {ANGLES['avg_phi_circ']} AS b FROM ({FTA})), g AS (SELECT DISTINCT label, event_number % 64 AS g FROM r),
      t AS (SELECT label, count(*) AS n, {r} AS r FROM r JOIN (SELECT label, {means} FROM r GROUP BY label) USING (label) GROUP BY label),
      l AS MATERIALIZED (SELECT g.label, g.g, a, b FROM g JOIN r ON r.label = g.label AND r.event_number % 64 <> g.g),
      j AS (SELECT label, count(*) AS groups, sqrt((count(*) - 1) * var_pop(atanh(r))) AS se_z FROM (SELECT label, g, {r} AS r FROM l JOIN (SELECT label, g, {means} FROM l GROUP BY ALL) USING (label, g) GROUP BY ALL) GROUP BY label)
      SELECT label, n, r, groups, se_z, tanh(atanh(r) - {t} * se_z) AS lo, tanh(atanh(r) + {t} * se_z) AS hi FROM t JOIN j USING (label)"""


q("V36_circular_cells", lambda c: cl.circular_circular(angled(c), ["label"], F.col("avg_phi"), F.col("avg_phi_circ")), "label n ~r groups ~se_z ~lo ~hi", _circ_sql())
ANGLE_ROWS = " UNION ALL ".join(f"SELECT label, '{a}' AS feature, {sql} AS o FROM ({FTA})" for a, sql in ANGLES.items())


def _direction_sql(keys: str, rows: str) -> str:
    sums = f"SELECT {keys}, count(*) AS n, avg(cos(o)) AS c, avg(sin(o)) AS s, avg(cos(2 * o)) AS c2, avg(sin(2 * o)) AS s2 FROM ({rows}) GROUP BY ALL"
    some = f"SELECT *, atan2(s, c) AS mean, sqrt(c * c + s * s) AS r FROM ({sums})"
    err = f"SELECT *, CASE WHEN n >= 25 THEN sqrt(greatest(0, 1 - c2 * cos(2 * mean) - s2 * sin(2 * mean)) / (2 * r * r) / n) END AS e FROM ({some})"
    return f"SELECT *, sqrt(greatest(0, -2 * ln(r))) AS sd, CASE WHEN n >= 2 THEN exp(-n * r * r) END AS rayleigh_p, mean - asin({Z} * se) AS lo, mean + asin({Z} * se) AS hi FROM (SELECT *, CASE WHEN {Z} * e < 1 THEN e END AS se FROM ({err}))"


DIRECTION = "n ~mean ~r ~sd ~se ~lo ~hi ~rayleigh_p"
q("V35_angle_describe", lambda c: cl.mean_direction(angled(c).select("label", F.inline(F.array(*[F.struct(F.lit(a).alias("feature"), F.col(a).alias("o")) for a in ANGLES]))), ["label", "feature"], F.col("o")), f"label $feature {DIRECTION}", _direction_sql("label, feature", ANGLE_ROWS))
q("V46_phi_residual", lambda c: cl.mean_direction(c.showers, ["b"], F.col("phi") - F.atan2("cyt", "cxt")), f"b {DIRECTION}", _direction_sql("b", "SELECT b, phi - atan2(cyt, cxt) AS o FROM sh"))


def _cards_sql() -> str:
    each = f"SELECT *, 'all' AS slice FROM sh UNION ALL SELECT *, CAST({SLICE} AS VARCHAR) FROM sh WHERE d IS NOT NULL"
    rows = "SELECT b, slice, 'energy' AS kind, energy_pred / p - 1 AS x, energy_pred - p AS o, energy_pred AS f, p AS t FROM each_slice UNION ALL SELECT b, slice, 'angle', 1e3 * (angle_pred - theta), 1e3 * (angle_pred - theta), angle_pred, theta FROM each_slice"
    by = f"SELECT b, slice, kind, count(*) AS n, avg(x) AS bias, stddev_samp(x) AS sd, avg(o * o) AS mse, stddev_samp(o * o) AS sq, corr(f, t) AS r FROM ({rows}) GROUP BY ALL"
    mean = lambda v, s, sign: f"{v} {sign} {T} * {s} / sqrt(n)"
    return f"""WITH each_slice AS ({each}) SELECT *, {mean('bias', 'sd', '-')} AS bias_lo, {mean('bias', 'sd', '+')} AS bias_hi, sd * sqrt((n - 1) / {CHI['lo']}) AS sd_lo, sd * sqrt((n - 1) / {CHI['hi']}) AS sd_hi, sqrt(mse) AS rmse,
      CASE WHEN n > 1 THEN sqrt(greatest(0, {mean('mse', 'sq', '-')})) END AS rmse_lo, sqrt({mean('mse', 'sq', '+')}) AS rmse_hi, CASE WHEN n > 3 THEN tanh(atanh(r) - {Z} / sqrt(n - 3)) END AS r_lo, CASE WHEN n > 3 THEN tanh(atanh(r) + {Z} / sqrt(n - 3)) END AS r_hi FROM ({by})"""


q("V42_residual_cards", lambda c: cl.residual_cards(c.showers), "b $slice $kind n ~bias ~bias_lo ~bias_hi ~sd ~sd_lo ~sd_hi ~rmse ~rmse_lo ~rmse_hi ~r ~r_lo ~r_hi", _cards_sql())
