"""Checks of derived tables on their failing sides, splits and picks against plain Python, and what model predictions give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerlake.operators import checks as ck
from showerlake.operators import events as ev
from showerlake.operators import models as md
from showerlake.operators import panels as pn
from showerlake.plans import registry, tables
from showerlake.sources.fixtures import fixture


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    c = fixture(spark, sf_dir)
    some = "event_number % 50 = 1"
    hits = c.hits.filter(some).persist()
    return hits, c.events.filter(some), ev.layers(hits).persist(), ev.profiles(hits).persist()


def test_partition_holds_and_fails(parts):
    hits, events, layers, prof = parts
    good = ck.check_partition(hits, events, layers, prof).first()
    assert good["hits_off"] == good["layers_off"] == good["axes_missing"] == good["failed"] == 0 and good["layer_residual"] < 1e-12
    first = hits.agg(F.min("event_number")).first()[0]
    of = lambda df, c, x: df.withColumn(c, F.when(F.col("event_number") == first, x).otherwise(F.col(c)))
    assert ck.check_partition(hits, events, of(layers, "e", F.col("e") * 2), prof).first()["layer_residual"] > 0.5
    off = ck.check_partition(hits, events, layers.filter(F.col("event_number") != first), prof).first()
    assert off["layers_off"] > 0 and off["failed"] == 1
    lost = ck.check_partition(hits, events, layers, prof.filter((F.col("event_number") != first) | (F.col("axis") == 0))).first()
    assert lost["axes_missing"] > 0 and lost["profile_residual"] < 1e-9 and lost["failed"] == 1
    assert ck.check_partition(hits, events, layers, of(prof, "e_neg", F.col("e_neg") + F.col("e"))).first()["negative_residual"] > 0.1
    assert ck.check_partition(hits.unionByName(hits.filter(F.col("event_number") == first)), events, layers, prof).first()["cells_twice"] > good["cells_twice"]
    assert ck.check_partition(hits, of(events, "n_own_a", F.col("n_own_a") + 1), layers, prof).first()["hits_off"] == 1


def test_contract_fails(parts):
    hits = parts[0]
    one = lambda name, x: ck.check_rows_contract(hits.withColumn(name, x)).first()
    assert one("p", F.col("p") + 1)["p_residual"] >= 1 and one("theta", F.col("theta") + 1)["theta_residual"] >= 1
    assert one("origin", F.lit("C"))["bad_origin"] == hits.count() and one("yl", F.col("yl") + 3)["rotation"] > 2.9
    assert one("yt", F.lit(float("nan")))["not_finite_all"] == hits.count() and one("gradcam", F.lit(2.0))["gradcam_outside"] > 0


def test_parity(spark):
    mine = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 0.0), (3, 1e-9, None), (4, None, 1.0)], "event_number long, f double, g double")
    theirs = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.5, 0.0), (3, 2e-9, None), (4, None, None), (9, 1.0, 1.0)], "event_number long, f double, g double")
    got = {r["feature"]: r for r in ck.feature_parity(mine, theirs, ["f", "g"]).collect()}
    assert math.isclose(got["f"]["rel"], 0.2) and got["f"]["worst"] == 2 and got["f"]["floor"] == 1.0 and got["f"]["n"] == 4
    assert got["g"]["rel"] == math.inf and got["g"]["worst"] == 4
    assert ck.feature_parity(mine.filter("f > 9"), theirs, ["f"]).count() == 0


def test_pick_uniform_of_ties(spark):
    numbers = [int(n) for n in np.random.default_rng(0).integers(0, 10**7, 300)] + [5, 5 + 1000003, 5 + 2 * 1000003]
    events = spark.createDataFrame([(n, 3, 1.0) for n in numbers] + [(77, 1, 1.0), (78, 9, None)], "event_number long, n_hits int, d double")
    order = sorted(numbers, key=lambda n: ((n * 7919 + 3 * 104729) % 1000003, n))
    for draw in (0, 1, 17, 150, len(order) - 1, len(order) + 4):
        assert [r["event_number"] for r in pn.pick_uniform(events, 3, draw).collect()] == [order[draw % len(order)]]
    assert pn.pick_uniform(events.filter("d IS NULL"), 3, 4).count() == 0


def test_split_check(spark):
    rng = np.random.default_rng(1)
    n, p, q = np.arange(0, 4000, 7), rng.normal(5, 1, 572), rng.normal(5, 1, 572)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(n, p, q)] + [(3, 1.0, None)], "event_number long, p double, pred double")
    got = {r["seed"]: r for r in md.split_check(df, 20).collect()}
    for seed in range(20):
        held = (n * 7919 + seed * 104729) % 1000003 % 5 == 0
        assert math.isclose(got[seed]["mse_valid"], ((p - q)[held] ** 2).mean()) and math.isclose(got[seed]["mse_train"], ((p - q)[~held] ** 2).mean())
        assert got[seed]["n_valid"] == held.sum() + ((3 * 7919 + seed * 104729) % 1000003 % 5 == 0)
    assert md.split_check(df.filter("p > 99")).count() == 0


def test_model_predictions(spark, sf_dir):
    c = fixture(spark, sf_dir)
    rows = tables.model_preds(c).toPandas()
    held = rows[rows["fold"] == 0]
    assert len(held) and set(held["event_number"] * 7919 % 1000003 % 5) == {0}
    run = lambda name: registry.queries()[name](spark, sf_dir).toPandas()
    perf = run("V56_model_perf").set_index("bin")
    for k, each in held.groupby("bin"):
        err = (each["pred"] - each["p"]).to_numpy()
        assert perf.loc[k, "n"] == len(err) and abs(perf.loc[k, "rmse"] - math.sqrt((err**2).mean())) < 2e-6 and abs(perf.loc[k, "median_abs"] - np.median(np.abs(err))) < 2e-6
    dense = run("V56_model_density")
    assert dense["n"].sum() == len(held) and len(dense) == len(set(zip(np.clip(np.floor(held["pred"]), -1, 20), np.clip(np.floor(held["p"]), -1, 20))))
    cm = run("X8_model_confusion").iloc[0]
    assert cm["tp"] == ((held["p"] > 2) & (held["pred"] > 2)).sum() and cm["n"] == len(held)
    sample = run("X7_model_sample")
    assert (sample["y"] == 0).sum() == min(1980, (held["p"] < 2).sum()) and set(sample["event_number"]) <= set(held["event_number"])
    some = run("J9_model_holdout")
    assert sorted(some["event_number"]) == sorted(held[held["p"].between(5, 10)]["event_number"])
    phi = run("V56_model_phi").set_index("bin")
    for k, each in held.groupby("bin"):
        z = np.exp(1j * (each["pred_phi"] - each["phi"])).mean()
        assert phi.loc[k, "n"] == len(each) and abs(phi.loc[k, "mean"] - np.angle(z)) < 2e-6 and abs(phi.loc[k, "r"] - abs(z)) < 2e-6
    split = run("X3_model_split_check").set_index("seed")
    sq = (rows["pred"] - rows["p"]) ** 2
    own = (rows["event_number"] * 7919 + 7 * 104729) % 1000003 % 5 == 0
    assert abs(split.loc[7, "mse_valid"] - sq[own].mean()) < 2e-6 and split.loc[7, "n_valid"] == own.sum()
