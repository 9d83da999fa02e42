"""Profile curves without the energy in front of the entry layer splat their hits once: that energy is a sum over hits."""

import pytest
from pyspark.sql import functions as F

from showerlake.operators import clusters as cl
from showerlake.operators import events as ev
from showerlake.operators import filters as fl
from showerlake.plans import clusters as plans
from showerlake.sources.fixtures import Fixture, fixture


def test_hits_are_splat_once(spark, sf_dir):
    plan = plans.curves(Fixture(spark, sf_dir), True)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Generate inline" in line and "ox" in line for line in plan.splitlines()) == 1


def test_lost_energy_is_that_of_the_profiles(spark, sf_dir):
    hits = fixture(spark, sf_dir).hits
    own = hits.groupBy("event_number", fl.own_shower(F.col("origin")).alias("b"))
    lost = F.sum(F.when(F.col("zl") < ev.NEGATIVE_DEPTH, F.col("energy")).otherwise(0.0)).alias("lost")
    prof, norm = ev.profiles(hits), own.agg(F.sum("energy").alias("e_own"))
    order = lambda df: [tuple(r) for r in df.orderBy("axis", "bin").collect()]
    by_profiles, by_hits = order(cl.profile_curves(prof, norm, None, True)), order(cl.profile_curves(prof, own.agg(F.sum("energy").alias("e_own"), lost), None, True))
    assert len(by_profiles) == len(by_hits) > 0
    for a, b in zip(by_profiles, by_hits, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-12)
