"""Queries that need few columns of the hits keep no others."""

import pytest
from pyspark.sql import functions as F

from showerlake.plans import registry
from showerlake.sources.fixtures import Fixture, fixture


def test_some_columns_of_all_kept_hits(spark, sf_dir):
    c, names = fixture(spark, sf_dir), ("event_number", "cell_id", "energy", "zl")
    few, all_ = c.some(*names), c.hits.select(*names)
    assert few.columns == list(names) and few.count() == all_.count() > 0
    assert few.exceptAll(all_).isEmpty() and all_.exceptAll(few).isEmpty()
    assert "q_ax" not in few.select(F.sum("zl"))._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[1].split("]")[0]


@pytest.mark.parametrize("name", ["G2_layer_pitch", "P34_event_attention", "V47_primaries", "E16_profiles", "C12_feature_parity"])
def test_wide_tables_are_not_kept(spark, sf_dir, name, monkeypatch):
    wide = property(lambda self: pytest.fail("the query keeps a table of all columns"))
    for table in ("raw", "single", "singles", "events"):
        monkeypatch.setattr(Fixture, table, wide)
    registry.queries()  # registers them
    registry.REGISTERED[name].build(Fixture(spark, sf_dir))
