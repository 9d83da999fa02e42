"""Queries of sources, orders and sets, checks and model analysis."""

import re
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import checks as ck
from ..operators import clusters as cl
from ..operators import events as ev
from ..operators import filters as fl
from ..operators import frames as fr
from ..operators import joins as jn
from ..operators import models as md
from ..operators import panels as pn
from ..sources import files as fs
from ..sources.shared import shuffles_dropped, written
from ..streaming import folder
from .base import KEYED
from .frames import DETREND, MARGINAL, marginal
from .panels import T, WILSON, table
from .registry import q

ALL = "rows ~energy ~zl events"
ALLSQL = "SELECT count(*) AS rows, sum(energy) AS energy, sum(zl) AS zl, count(DISTINCT event_number) AS events FROM raw"


def digest(df):
    return df.agg(F.count("*").alias("rows"), F.sum("energy").alias("energy"), F.sum("zl").alias("zl"), F.countDistinct("event_number").alias("events"))


def typed(c, kind="two"):
    df = c.source if kind == "two" else c.single_source if kind == "one" else feature_rows(c)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in fs.schema(kind)])


def feature_rows(c):
    df = ev.shape_sums(c.single)
    for prefix, f in fs.FEATURE_FRAMES.items():
        df = ev.features(df, f, prefix)
    return df.join(c.singles.select("event_number", "p", "p_bin", "theta", "phi"), "event_number").withColumn("label", (F.col("p") >= 2).cast("int"))


def as_csv(c):
    path = fs.scratch(c.spark, "csv")
    typed(c).write.option("header", True).option("emptyValue", "").csv(path)
    return path


def as_parquet(c, kind="two"):
    path = fs.scratch(c.spark, "parquet")
    columns = [f.name for f in fs.schema(kind)]
    with shuffles_dropped(c.spark):
        typed(c, kind).select("*", F.lit(0).alias("__index_level_0__")).select("__index_level_0__", *reversed(columns)).write.option("compression", "zstd").parquet(path)
    return path


def archived(c):
    path = fs.scratch(c.spark, "archive")
    fs.write_archive(typed(c), path)
    return path


def two_parts(c):
    a, b = fs.scratch(c.spark, "part"), fs.scratch(c.spark, "part")
    fs.write_archive(typed(c).filter("event_number % 2 = 0"), a)
    fs.write_archive(typed(c).filter("event_number % 2 = 1"), b)
    return fs.read_archive(c.spark, [a, b], "two")


def ingested(c, rebuild=False, kind="two"):
    """The tables of an ingest of all rows. A rebuild finds the archive alone: the first tables are gone, and needn't lie beside the new ones."""
    target = fs.scratch(c.spark, "dataset")
    out = fs.ingest(c.spark, as_parquet(c, kind), target, kind, consume=True)
    if rebuild:
        fs.drop_derived(c.spark, target)
        out = fs.rebuild(c.spark, target)
    return out


def published(c):
    """The checks of an ingest's tables against the source that it was loaded from."""
    source = as_parquet(c)
    return ck.failures(fs.read_hits_parquet(c.spark, source, "two"), fs.ingest(c.spark, source, fs.scratch(c.spark, "dataset"), "two"))


def dropped(c):
    source, target = fs.scratch(c.spark, "drop"), fs.scratch(c.spark, "loaded")
    for part in (0, 1):
        typed(c).filter(F.col("event_number") % 2 == part).write.mode("append").parquet(source)
        out = folder.ingest_folder(c.spark, source, target, target + "-checkpoint", fs.schema("two"))
    return out


def dropped_datasets(c):
    """All hits as files, each a dataset of whole events, dropped in two goes, the second run finding the first one's files again."""
    source, root = fs.scratch(c.spark, "drop"), fs.scratch(c.spark, "datasets")
    for part in (0, 1):
        with shuffles_dropped(c.spark):
            typed(c).filter(F.col("event_number") % 2 == part).repartition(2, "event_number").write.mode("append").parquet(source)
        log = folder.ingest_datasets(c.spark, source, root, root + "-checkpoint", settle=0)
    loaded = [r["dataset"] for r in log.filter("action = 'loaded'").collect()]
    events = reduce(DataFrame.unionByName, [fs.current(c.spark, f"{root}/{name}")["events"] for name in loaded])
    return events.select("event_number", "n_hits", "e_dep", "d").withColumn("datasets", F.lit(log.count()))


q("L1_read_hits_csv", lambda c: digest(fs.read_hits_csv(c.spark, as_csv(c), "two")), ALL, ALLSQL)
q("L2_read_hits_parquet", lambda c: fs.read_hits_parquet(c.spark, as_parquet(c), "two"), "event_number cell_id $origin ~energy $daughter_type", "SELECT * FROM raw")
q("L3_audit_source", lambda c: fs.audit_source(typed(c), "two"), "rows out_of_range integers", "SELECT count(*) AS rows, 0 AS out_of_range, 6 AS integers FROM raw")
q("L4_nan_to_null", lambda c: fs.nan_to_null(c.events.select(F.coalesce("d", F.lit(float("nan"))).alias("d")), ["d"])[0].agg(F.count("*").alias("n"), F.count("d").alias("defined"), F.sum("d").alias("sum")), "n defined ~sum", "SELECT count(*) AS n, count(d) AS defined, sum(d) AS sum FROM ev")
q("L5_write_archive", lambda c: digest(c.spark.read.parquet(archived(c))), ALL, ALLSQL)
q("L6_read_archive", lambda c: digest(two_parts(c)), ALL, ALLSQL)
q("L7_append_part", lambda c: digest(fs.append_part(typed(c), typed(c), 10_000_000)), ALL, "SELECT 2 * rows AS rows, 2 * energy AS energy, 2 * zl AS zl, 2 * events AS events FROM (" + ALLSQL + ")")
q("L8_ingest", lambda c: ingested(c)["events"], "event_number n_hits ~e_dep ~d", "SELECT * FROM ev")
q("L8_ingest_shapes", lambda c: ingested(c)["shape_sums"].groupBy("event_number").agg(F.sum("n").alias("n"), F.sum("sum_ezl").alias("ez"), F.max("max_r_l").alias("r")), "event_number n ~ez ~r", "SELECT event_number, count(*) AS n, sum(energy * zl) AS ez, max(sqrt(xl * xl + yl * yl + zl * zl)) AS r FROM hits GROUP BY 1")
q("L8_ingest_profiles", lambda c: ingested(c)["profiles"].groupBy("event_number", "b", "axis").agg(F.sum("e").alias("e")), "event_number b axis ~e", "SELECT event_number, CASE WHEN origin = 'A' THEN 0 ELSE 1 END AS b, axis, sum(energy) AS e FROM hits, range(2) a(axis) GROUP BY ALL")
q("L8_ingest_one", lambda c: ingested(c, kind="one")["events"], "event_number n_hits ~e_dep n_primary $primary_type ~cxl", "SELECT * FROM sg")
q("L8_ingest_features", lambda c: ingested(c, kind="features")["events"], "event_number n label ~p ~local_width ~local_mean_r ~local_avg_theta", "SELECT ft0.*, ft0.width AS local_width, ft0.mean_r AS local_mean_r, ft0.avg_theta AS local_avg_theta, sg.p, CASE WHEN sg.p >= 2 THEN 1 ELSE 0 END AS label FROM ft0 JOIN sg USING (event_number)")
q("L9_rebuild", lambda c: ingested(c, True)["layers"], "event_number b layer ~e n", "SELECT * FROM lay")
q("L10_publish", published, "$check failed", "SELECT unnest(['projection', 'lattice', 'energy', 'derived', 'undefined_d', 'shape_sums', 'profiles']) AS \"check\", 0 AS failed FROM (SELECT count(*) FROM raw)")
q("L11_ingest_folder", lambda c: digest(dropped(c)), ALL, ALLSQL)
q("L11_checked_folder", dropped_datasets, "event_number n_hits ~e_dep ~d datasets", "SELECT *, 4 AS datasets FROM ev")
q("L12_csv_to_parquet", lambda c: digest(fs.csv_to_parquet(c.spark, as_csv(c), fs.scratch(c.spark, "typed"), "two")), ALL, ALLSQL)
q("L13_catalogue", lambda c: fs.catalogue(c.hits, c.events), "n_hits ~energy n_events ~min_e1 ~max_e1 ~max_d n_x n_y n_z", "SELECT * FROM (SELECT count(*) AS n_hits, sum(energy) AS energy, count(DISTINCT x) AS n_x, count(DISTINCT y) AS n_y, count(DISTINCT z) AS n_z FROM hits), (SELECT count(*) AS n_events, min(e1) AS min_e1, max(e1) AS max_e1, max(d) AS max_d FROM ev)")

# --- orders, sets, windows --------------------------------------------------------------------------
q("O1_sorted_hits", lambda c: c.hits.repartitionByRange("event_number").sortWithinPartitions("event_number", "iz", "iy", "ix"), "event_number iz iy ix ~energy", "SELECT * FROM hits ORDER BY event_number, iz, iy, ix")
q("O2_top_k", lambda c: fr.top_cells(c.events, "e_dep", 25, "event_number"), "event_number ~e_dep", "SELECT * FROM ev ORDER BY round(e_dep, 9) DESC, event_number LIMIT 25")
q("O3_ordinal", lambda c: jn.ordinal(c.hits, "x"), "~x k", "SELECT x, row_number() OVER (ORDER BY x) - 1 AS k FROM (SELECT DISTINCT x FROM hits)")
q("O4_stack", lambda c: c.events.select("event_number", F.col("e1").alias("e")).unionByName(c.events.select("event_number", F.col("e2").alias("e"))), "event_number ~e", "SELECT event_number, e1 AS e FROM ev UNION ALL SELECT event_number, e2 FROM ev")
q("O5_distinct", lambda c: c.hits.select("ix", "iy", "origin").distinct(), "ix iy $origin", "SELECT DISTINCT ix, iy, origin FROM hits")
q("O6_only_in", lambda c: jn.only_in(c.events.filter("n_hits > 2"), c.events.filter("d > 100")), "event_number n_hits", "SELECT * FROM ev WHERE n_hits > 2 AND NOT coalesce(d > 100, FALSE)")
q("O7_cumulative_share", lambda c: fr.running_share(marginal(c), "e", "bin"), "bin ~share", f"SELECT bin, sum(e) OVER (ORDER BY bin) / sum(e) OVER () AS share FROM ({MARGINAL})")
q("O8_detrend", lambda c: fr.detrend(marginal(c)), "bin ~rest ~before", DETREND)
q("O9_lead_row", lambda c: c.hits.withColumn("k", F.row_number().over(Window.partitionBy("event_number").orderBy(F.desc("energy"), "cell_id", "origin"))).filter("k = 1"), "event_number cell_id ~energy", "SELECT event_number, cell_id, energy FROM hits QUALIFY row_number() OVER (PARTITION BY event_number ORDER BY energy DESC, cell_id, origin) = 1")

# --- checks --------------------------------------------------------------------------------------------
q("C1_check_rows", lambda c: ck.check_rows(c.raw, two_parts(c)), "source archive failed", "SELECT count(*) AS source, count(*) AS archive, 0 AS failed FROM raw")
q("C2_check_projection", lambda c: ck.check_projection(c.raw, fl.project_rows(c.hits)), "rows kept events kept_events warned failed", "SELECT count(*) AS rows, count(*) FILTER (WHERE energy > 0) AS kept, count(DISTINCT event_number) AS events, count(DISTINCT event_number) FILTER (WHERE energy > 0) AS kept_events, 0 AS warned, 0 AS failed FROM raw")
q("C3_check_lattice", lambda c: ck.check_lattice(c.hits), "max_ix max_iy max_iz least failed", "SELECT max(ix) AS max_ix, max(iy) AS max_iy, max(iz) AS max_iz, 0 AS least, 0 AS failed FROM hits")
q("C4_check_energy", lambda c: ck.check_energy(c.hits), "~energy not_finite failed", "SELECT sum(energy) AS energy, 0 AS not_finite, 0 AS failed FROM hits")
PARTS = f"""WITH k AS MATERIALIZED ({KEYED}), s AS (SELECT event_number, CASE WHEN origin = 'A' THEN 0 ELSE 1 END AS b, count(*) AS n, count(DISTINCT cell_id) AS cells, sum(energy) AS e, coalesce(sum(energy) FILTER (WHERE zl < -1025e-2), 0) AS en FROM hits GROUP BY ALL),
  pr AS (SELECT event_number, b, sum(v) AS e, coalesce(sum(v) FILTER (WHERE neg), 0) AS en FROM k GROUP BY ALL), la AS (SELECT event_number, b, sum(n) AS n, sum(e) AS e FROM lay GROUP BY ALL)
  SELECT (SELECT count(*) FROM ev WHERE n_own_a + n_own_b <> n_hits) AS hits_off, (SELECT max(abs(e_own_a + e_own_b - e_dep) / e_dep) FROM ev) AS shower_residual, count(*) FILTER (WHERE s.n <> cells) AS cells_twice,
    count(*) FILTER (WHERE la.n IS DISTINCT FROM s.n) AS layers_off, max(abs(la.e - s.e) / s.e) AS layer_residual, 2 * count(*) FILTER (WHERE pr.e IS NULL) AS axes_missing, max(abs(pr.e - s.e) / s.e) AS profile_residual, max(abs(pr.en - s.en) / s.e) AS negative_residual
  FROM s LEFT JOIN la ON la.event_number = s.event_number AND la.b = s.b LEFT JOIN pr ON pr.event_number = s.event_number AND pr.b = s.b"""
q("C5_check_derived", lambda c: ck.check_partition(c.hits, c.events, ev.layers(c.hits), ev.profiles(c.hits)), "hits_off ~shower_residual cells_twice layers_off ~layer_residual axes_missing ~profile_residual ~negative_residual failed", f"SELECT *, CASE WHEN hits_off > 0 THEN 1 ELSE 0 END + CASE WHEN layers_off > 0 THEN 1 ELSE 0 END + CASE WHEN axes_missing > 0 THEN 1 ELSE 0 END + CASE WHEN shower_residual > 1e-12 THEN 1 ELSE 0 END + CASE WHEN greatest(layer_residual, profile_residual, negative_residual) > 1e-9 THEN 1 ELSE 0 END AS failed FROM ({PARTS})")
q("C6_check_undefined_d", lambda c: ck.check_undefined_d(c.events), "n undefined failed", "SELECT count(*) AS n, count(*) - count(d) AS undefined, 0 AS failed FROM ev")
TURNED = "greatest(abs(xl - (cos(theta) * cos(phi) * xt + cos(theta) * sin(phi) * yt - sin(theta) * zt)), abs(yl - (cos(phi) * yt - sin(phi) * xt)), abs(zl - (sin(theta) * cos(phi) * xt + sin(theta) * sin(phi) * yt + cos(theta) * zt)))"
q("C7_check_rows_contract", lambda c: ck.check_rows_contract(c.hits), "not_finite not_finite_all ~rotation ~layer out_of_range true_out_of_range gradcam_outside shapcam_outside off_origin bad_origin ~p_residual ~theta_residual", f"SELECT count(*) FILTER (WHERE NOT isfinite(xl)) AS not_finite, count(*) FILTER (WHERE NOT isfinite(x + y + z + xt + yt + zt + xl + yl + zl)) AS not_finite_all, max({TURNED}) AS rotation, max(abs(zt / 205e-1 - round(zt / 205e-1))) AS layer, count(*) FILTER (WHERE seg_pred < 0 OR seg_pred > 1) AS out_of_range, count(*) FILTER (WHERE seg_true < 0 OR seg_true > 1) AS true_out_of_range, count(*) FILTER (WHERE gradcam < 0 OR gradcam > 1) AS gradcam_outside, count(*) FILTER (WHERE abs(shapcam) > 1) AS shapcam_outside, count(*) FILTER (WHERE origin = 'A+B' AND (xt <> 0 OR yt <> 0 OR zt <> 0)) AS off_origin, count(*) FILTER (WHERE origin IS NULL OR origin NOT IN ('A', 'B', 'A+B')) AS bad_origin, max(abs(p - CASE origin WHEN 'A' THEN p_a ELSE p_b END)) FILTER (WHERE origin <> 'A+B') AS p_residual, max(abs(theta - CASE origin WHEN 'A' THEN theta_a ELSE theta_b END)) FILTER (WHERE origin <> 'A+B') AS theta_residual FROM hits")
q("C8_check_p0", lambda c: ck.check_p0(c.hits), "n ~mean ~worst", "SELECT count(*) AS n, avg(d) AS mean, max(d) AS worst FROM (SELECT sqrt(pow(sum(energy * x) FILTER (WHERE z = z0) / sum(energy) FILTER (WHERE z = z0) - avg(x - xt), 2) + pow(sum(energy * y) FILTER (WHERE z = z0) / sum(energy) FILTER (WHERE z = z0) - avg(y - yt), 2)) AS d FROM (SELECT *, origin = 'A' AS a, min(z) OVER (PARTITION BY event_number, origin = 'A') AS z0 FROM hits) GROUP BY event_number, a)")
ANCHORS = tuple(f"{c}{s}{a}" for c in ("c", "p0") for s in "ab" for a in "xyz") + ("theta_a", "theta_b", "phi_a", "phi_b", "d")
q("C9_anchor_residual", lambda c: ck.anchor_residual(c.some_events(("x", "y", "z", "xt", "yt", "zt", "theta_a", "theta_b", "phi_a", "phi_b"), ANCHORS).filter("d IS NOT NULL")), "$shower ~median ~p90 over", "SELECT shower, median(r) AS median, quantile_cont(r, 9e-1) AS p90, count(*) FILTER (WHERE r > 505e-1) AS over FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS shower, sqrt(pow(c{s}x - p0{s}x - (c{s}z - p0{s}z) * tan(theta_{s}) * cos(phi_{s}), 2) + pow(c{s}y - p0{s}y - (c{s}z - p0{s}z) * tan(theta_{s}) * sin(phi_{s}), 2)) AS r FROM ev WHERE d IS NOT NULL" for s in "ab") + ") GROUP BY shower")
q("C10_check_single", lambda c: ck.check_single(c.single), "repeated off_bin unknown parents", "SELECT 0 AS repeated, count(*) FILTER (WHERE p_bin <> floor(p)) AS off_bin, 0 AS unknown, 0 AS parents FROM single")
q("C11_check_events", lambda c: ck.check_events(table(c)), "n label_off floored out_of_range", "SELECT count(*) AS n, 0 AS label_off, count(*) FILTER (WHERE width <= 1e-6) AS floored, 0 AS out_of_range FROM ft WHERE n > 1")
PARITY = "SELECT event_number, 'width' AS feature, width AS u, greatest(max_xt - min_xt, 1e-6) AS v FROM ft0 UNION ALL SELECT event_number, 'height', height, greatest(max_yt - min_yt, 1e-6) FROM ft0 UNION ALL SELECT event_number, 'mean_r', mean_r, CASE WHEN sum_r_t = 0 THEN 0 ELSE sum_r_t / n END FROM ft0"
q("C12_feature_parity", lambda c: ck.feature_parity(ev.features(ev.shape_sums(c.single_source)), ev.features(ev.shape_sums(c.single_source), "t"), ["width", "height", "mean_r"]), "$feature ~rel n ~floor worst", f"SELECT feature, max(rel) AS rel, count(*) AS n, any_value(floor) AS floor, min(event_number) FILTER (WHERE rel = top) AS worst FROM (SELECT *, max(rel) OVER (PARTITION BY feature) AS top FROM (SELECT event_number, feature, floor, coalesce(round(abs(u - v) / nullif(greatest(abs(u), abs(v), floor), 0), 9), 0) AS rel FROM ({PARITY}) p JOIN (SELECT feature, median(abs(v)) AS floor FROM ({PARITY}) GROUP BY 1) m USING (feature))) GROUP BY feature")

# --- model analysis ---------------------------------------------------------------------------------------
FOLD = "(event_number * 7919) % 1000003 % 5"
PRED = "SELECT event_number, b, p, energy_pred AS pred, theta, angle_pred FROM sh"


def preds(c):
    return c.showers.select("event_number", "b", "p", F.col("energy_pred").alias("pred"), "theta", "angle_pred", "phi")


def modelled(c):
    """What fits and their readers need of the feature table, and the outputs, in one pass over the hits and written once: fits
    read it many times."""
    sums = ev.shape_sums(c.single_source, more={o: F.max(o) for o in md.OUTPUTS})
    return written(ev.features(sums).filter("n > 1").select("event_number", *md.FEATURES, *md.OUTPUTS), "modelled")


@lru_cache(2)
def fitted(c, trees=100):
    """The models of all outputs and folds, and their table."""
    rows = modelled(c)
    return md.fit_outputs(rows, trees=trees), rows


def refits(c):
    preds = md.predict_outputs(*fitted(c))
    parts = [md.fold_metrics(preds, f"pred_{o}", o, o == "phi").withColumn("output", F.lit(o)) for o in md.OUTPUTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def gains(c):
    rows = [(o, k, f, g) for (o, k), each in fitted(c)[0].importance().items() for f, g in each]
    return c.spark.createDataFrame(rows, "output string, fold int, feature string, gain double")


q("X1_split", lambda c: md.split(preds(c)), "event_number b holdout", f"SELECT *, CASE WHEN {FOLD} = 0 THEN 1 ELSE 0 END AS holdout FROM ({PRED})")
q("X2_fit", lambda c: md.predict_outputs(*fitted(c)), "event_number fold ~p ~pred_p ~theta ~pred_theta ~phi ~pred_phi")
q("X3_split_check", lambda c: md.split_check(preds(c)), "seed ~mse_valid ~mse_train n_valid", f"SELECT seed, avg(pow(pred - p, 2)) FILTER (WHERE h = 0) AS mse_valid, avg(pow(pred - p, 2)) FILTER (WHERE h <> 0) AS mse_train, count(*) FILTER (WHERE h = 0) AS n_valid FROM (SELECT *, (event_number * 7919 + seed * 104729) % 1000003 % 5 AS h FROM ({PRED}), range(100) r(seed)) GROUP BY seed")
FM = f"SELECT {FOLD} AS fold, count(*) AS n, avg(abs(pred - p)) AS mae, avg(pow(pred - p, 2)) AS mse, sqrt(avg(pow(pred - p, 2))) AS rmse, 1 - avg(pow(pred - p, 2)) / var_pop(p) AS r2 FROM ({PRED}) GROUP BY 1"
q("X4_fold_metrics", lambda c: md.fold_metrics(preds(c)), "fold n ~mae ~mse ~rmse ~r2", FM)
q("X4_fold_refits", refits, "$output fold n ~mae ~rmse ~r2")
q("X5_mean_interval", lambda c: md.mean_interval(md.fold_metrics(preds(c))), "k ~mean ~lo ~hi", f"SELECT n AS k, mean, mean - {T} * s * sqrt(1e0 / n + 1e0 / (n - 1)) AS lo, mean + {T} * s * sqrt(1e0 / n + 1e0 / (n - 1)) AS hi FROM (SELECT count(*) AS n, avg(mae) AS mean, stddev_samp(mae) AS s FROM ({FM}))")
q("X6_output_order", lambda c: md.output_order(preds(c), ["pred", "angle_pred"], ["p", "theta"]), "$output $label ~mse", "SELECT output, label, avg(sq) AS mse FROM (" + " UNION ALL ".join(f"SELECT '{o}' AS output, '{t}' AS label, pow({o} - {t}, 2) AS sq FROM ({PRED})" for o in ("pred", "angle_pred") for t in ("p", "theta")) + ") GROUP BY ALL")
HELDOUT = f"SELECT *, CASE WHEN (SELECT count(*) FROM ({PRED}) WHERE b = 0 AND p > 10 AND {FOLD} = 0) < 50 THEN 1 ELSE 0 END AS fallback FROM ({PRED}) WHERE b = 0 AND {FOLD} = 0"
q("X7_binary_sample", lambda c: md.binary_sample(preds(c).filter("b = 0")), "event_number y ~p fallback", f"SELECT event_number, 0 AS y, p, fallback FROM (SELECT * FROM ({HELDOUT}) WHERE p < 2 ORDER BY (event_number * 7919) % 1000003, event_number LIMIT 1980) UNION ALL SELECT event_number, 1, p, fallback FROM (SELECT * FROM ({HELDOUT}) WHERE p > CASE WHEN fallback = 1 THEN 2 ELSE 10 END ORDER BY (event_number * 7919) % 1000003, event_number LIMIT 20)")
RATES = {"accuracy": ("tp + tn", "n"), "recall": ("tp", "tp + fn"), "recall_0": ("tn", "tn + fp"), "precision": ("tp", "tp + fp"), "precision_0": ("tn", "tn + fn")}


def _rates_sql() -> str:
    counts = "SELECT count(*) FILTER (WHERE p > 2 AND pred > 2) AS tp, count(*) FILTER (WHERE p <= 2 AND pred > 2) AS fp, count(*) FILTER (WHERE p > 2 AND pred <= 2) AS fn, count(*) FILTER (WHERE p <= 2 AND pred <= 2) AS tn, count(*) AS n FROM (" + PRED + ")"
    limit = lambda k, n, sign: re.sub(r"\bk\b", f"({k})", re.sub(r"\bn\b", f"nullif(({n.replace('n', '@')}), 0)", WILSON.format(s=sign))).replace("@", "n")
    each = ", ".join(f"({k}) / nullif(CAST({n} AS DOUBLE), 0) AS {name}, {limit(k, n, '-')} AS {name}_lo, {limit(k, n, '+')} AS {name}_hi" for name, (k, n) in RATES.items())
    half = "sqrt(pow(recall - recall_{e}, 2) + pow(recall_0 - recall_0_{e}, 2)) / 2"
    return f"SELECT *, (recall + recall_0) / 2 AS balanced, greatest(0, (recall + recall_0) / 2 - {half.format(e='lo')}) AS balanced_lo, least(1, (recall + recall_0) / 2 + {half.format(e='hi')}) AS balanced_hi FROM (SELECT tp, fp, fn, tn, n, {each} FROM ({counts}) c)"


q("X8_confusion", lambda c: md.confusion(preds(c)), "tp fp fn tn n " + " ".join(f"~{r} ~{r}_lo ~{r}_hi" for r in [*RATES, "balanced"]), _rates_sql())
q("X9_surrogate", lambda c: md.surrogate(md.predict_outputs(*fitted(c)), "pred_p"), "~leaf n ~value ~variance ~r2 ~mae")


def model_preds(c):
    """Out-of-fold predictions of the fitted models, with the columns of the stored ones; fold 0 is the holdout."""
    p = md.predict_outputs(*fitted(c))
    return p.select("event_number", F.lit(0).alias("b"), "p", F.col("pred_p").alias("pred"), F.col("pred_p").alias("energy_pred"), "theta", F.col("pred_theta").alias("angle_pred"), "phi", "pred_phi", F.floor("p").cast("int").alias("bin"), "fold")


def model_held(c):
    return model_preds(c).filter("fold = 0")


q("X3_model_split_check", lambda c: md.split_check(model_preds(c)), "seed ~mse_valid ~mse_train n_valid")
q("X7_model_sample", lambda c: md.binary_sample(model_preds(c)), "event_number y ~p ~pred fallback")
q("X8_model_confusion", lambda c: md.confusion(model_held(c)), "tp fp fn tn n ~accuracy ~accuracy_lo ~accuracy_hi ~recall ~precision ~balanced ~balanced_lo ~balanced_hi")
q("J9_model_holdout", lambda c: jn.restrict(model_held(c), c.singles.filter("p BETWEEN 5 AND 10")), "event_number ~p ~pred ~theta ~angle_pred ~phi ~pred_phi")
q("V56_model_perf", lambda c: pn.perf_bins(model_held(c)), "b bin n ~rmse ~mae ~bias ~median_rel ~median_abs missing")
q("V56_model_density", lambda c: pn.pred_density(model_held(c)), "b pb tb n")
q("V56_model_phi", lambda c: cl.mean_direction(model_held(c), ["bin"], F.col("pred_phi") - F.col("phi")), "bin n ~mean ~r ~sd ~se ~lo ~hi")
q("X10_circ_fidelity", lambda c: md.circ_fidelity(c.showers.withColumn("at", F.atan2("cyt", "cxt")), "at", "phi"), "~fidelity ~mae", "WITH s AS (SELECT phi, atan2(cyt, cxt) AS a FROM sh), m AS (SELECT atan2(avg(sin(phi)), avg(cos(phi))) AS m FROM s) SELECT 1 - sum(1 - cos(a - phi)) / sum(1 - cos(phi - m)) AS fidelity, avg(abs(atan2(sin(a - phi), cos(a - phi)))) AS mae FROM s, m")
q("X11_importance", gains, "$output fold $feature ~gain")
q("X12_stamp", lambda c: md.arithmetic_stamp(c.events, "event_number", "n_hits"), "n sum", "SELECT count(*) AS n, sum((event_number * 7919 + n_hits * 104729) % 1000003) AS sum FROM ev")
q("X12_stamp_of_values", lambda c: md.stamp(c.events.select("event_number", "n_hits", "n_ab")), "n hash", "SELECT count(*) AS n, sum(CAST('0x' || substr(md5(event_number || '|' || n_ab || '|' || n_hits), 1, 8) AS BIGINT)) AS hash FROM ev")


def _tree_sql(levels: int, changed: bool = False) -> str:
    n_ab = "CASE WHEN event_number % 5003 = 5 THEN n_ab + 1 ELSE n_ab END" if changed else "n_ab"
    text = "||".join(f"length(CAST({c} AS VARCHAR)) || ':' || {c}" for c in ("event_number", "n_ab", "n_hits"))
    parts = " || ',' || ".join(f"CAST(sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))
    sql = f"SELECT event_number AS pos, count(*) AS n, {parts} AS digest FROM (SELECT event_number, sha256({text}) AS h FROM (SELECT event_number, {n_ab} AS n_ab, n_hits FROM ev) GROUP BY ALL) GROUP BY 1"
    for _ in range(levels):
        sql = f"SELECT pos // 1024 AS pos, sum(n) AS n, sha256(string_agg(pos || '|' || n || '|' || digest, ';' ORDER BY pos)) AS digest FROM ({sql}) GROUP BY 1"
    return sql


def stamped(c):
    return c.events.select("event_number", "n_hits", "n_ab")


q("X12_ordered_stamp", lambda c: md.ordered_stamp(stamped(c), "event_number"), "n $digest", f"SELECT sum(n) AS n, sha256(string_agg(pos || '|' || digest, ';' ORDER BY pos)) AS digest FROM ({_tree_sql(6)})")
q("X12_changed_ranges", lambda c: md.changed_ranges(stamped(c), stamped(c).withColumn("n_ab", F.when(F.col("event_number") % 5003 == 5, F.col("n_ab") + 1).otherwise(F.col("n_ab"))), "event_number"), "lo hi n_old n_new", f"SELECT a.pos * 1024 AS lo, a.pos * 1024 + 1023 AS hi, a.n AS n_old, b.n AS n_new FROM ({_tree_sql(1)}) a JOIN ({_tree_sql(1, True)}) b ON a.pos = b.pos WHERE a.digest <> b.digest")
