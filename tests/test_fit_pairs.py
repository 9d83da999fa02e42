"""Sums of a pass by pairs of features, and scores that a fit keeps without writing them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerlake.operators import boosting


@pytest.mark.parametrize("together", [1, 2])
@pytest.mark.parametrize("features", [1, 2, 5])
def test_sums_of_pairs_taken_apart(features, together):
    rng = np.random.default_rng(features)
    codes, rest, node, size = rng.integers(0, 4, (features, 90)).astype(np.uint8), rng.normal(size=90), rng.integers(0, 2, 90), 4
    places, wide = boosting._places(codes, size, together), size**together
    both = np.stack([np.bincount(p + node * wide, rest, 2 * wide) for p in places]).reshape(1, 1, -1, 2, wide)
    want = np.stack([[np.bincount(c[node == i], rest[node == i], size) for c in codes] for i in (0, 1)])
    assert np.allclose(boosting._apart(both, features, size, together), want[None, None])


def test_scores_are_kept_and_written_once(spark, monkeypatch):
    seen, written = [], boosting.written
    monkeypatch.setattr(boosting, "written", lambda df, name: seen.append(name) or written(df, name))
    df = spark.range(60).select("id", F.col("id").cast("double").alias("a"), (F.col("id") * 5 % 11).cast("double").alias("y"))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = boosting.fit(df, F.col("id") % 3, ("a",), ("y",), (0, 1), trees=12)
    assert len(model.values) == 12 and seen == ["boosting"]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
