"""Panels of few columns of the events keep no wide tables, and find the same rows."""

import pytest

from showerlake.operators import filters as fl
from showerlake.plans import registry
from showerlake.sources.fixtures import Fixture, fixture


def test_series_of_showers_are_those_of_all_columns(spark, sf_dir):
    c = fixture(spark, sf_dir)
    few = c.series_showers()
    all_ = c.showers.select(*few.columns)
    near = lambda df: df.selectExpr("event_number", "b", "bin", "n_own", *[f"round({n}, 9) as {n}" for n in ("d", "e1", "e2", "p", "theta", "energy_pred", "e_own")])
    assert few.count() == all_.count() > 0 and near(few).exceptAll(near(all_)).isEmpty()
    assert set(few.columns) < set(fl.SHOWER_COLUMNS) | {"event_number", "b", "d", "e1", "e2"}


@pytest.mark.parametrize("name", ["V7_energy_by_d", "V14_pooled_scale", "C9_anchor_residual", "V56_holdout_perf"])
def test_wide_tables_are_not_kept(spark, sf_dir, name, monkeypatch):
    wide = property(lambda self: pytest.fail("the query keeps a table of all columns"))
    for table in ("raw", "single", "singles", "events"):
        monkeypatch.setattr(Fixture, table, wide)
    registry.queries()  # registers them
    registry.REGISTERED[name].build(Fixture(spark, sf_dir))
