"""Profile curves deal their hits by event once, and keep no wide table."""

import pytest

from showerlake.plans import registry
from showerlake.sources.fixtures import Fixture


@pytest.mark.parametrize("name", ["V25_profile_curves", "V25_curves_without_negative"])
def test_splats_and_sums_are_not_dealt_again(spark, sf_dir, name, monkeypatch):
    wide = property(lambda self: pytest.fail("the query keeps a table of all columns"))
    for table in ("raw", "single", "singles", "events"):
        monkeypatch.setattr(Fixture, table, wide)
    registry.queries()  # registers them
    df = registry.REGISTERED[name].build(Fixture(spark, sf_dir))
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert not [line for line in dealt if "jw#" in line or "jr#" in line or "b#" in line], dealt
