"""Trees over packed blocks of rows, and what reads their predictions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerlake.operators import boosting
from showerlake.operators import models as md


@pytest.mark.parametrize("bins", [64, 400])
def test_nodes_and_scores_of_some_models(bins):
    rng = np.random.default_rng(3)
    edges = [np.sort(rng.uniform(0, 1, bins - 1)) for _ in range(3)]
    model = boosting.Boosted(("a", "b", "c"), ("y", "z"), (0, 1), 3, edges, np.arange(4.0))
    for _ in range(3):
        model.split_feature.append(rng.integers(-1, 3, (4, 7)))
        model.split_bin.append(rng.integers(0, bins - 1, (4, 7)))
        model.values.append(rng.normal(size=(4, 8)))
    x = rng.uniform(0, 1, (50, 3))
    codes = model.codes(x)
    assert codes.shape == (3, 50) and codes.dtype == (np.uint8 if bins == 64 else np.uint16)
    want = np.zeros((4, 50))
    for m in range(4):
        for i in range(50):
            want[m, i] = model.base[m]
            for f, s, v in zip(model.split_feature, model.split_bin, model.values, strict=True):
                at = 0
                for level in range(3):
                    inner = 2**level - 1 + at
                    at = 2 * at + int(f[m, inner] >= 0 and codes[f[m, inner], i] > s[m, inner])
                want[m, i] += v[m, at]
    start = np.tile(model.base[:, None], (1, 50))
    assert np.allclose(model.added(codes, start, 0), want) and np.array_equal(start[:, 0], model.base)
    assert np.allclose(model.added(codes, start[[1, 3]], 0, np.array([1, 3])), want[[1, 3]])


def test_the_surrogate_reads_predictions_that_are_written(spark):
    df = spark.range(300).select(*[(F.col("id") * (i + 3) % 17).cast("double").alias(c) for i, c in enumerate(md.FEATURES)], F.col("id").cast("double").alias("pred"))
    predicted = df.mapInArrow(lambda batches: batches, df.schema)
    plan = md.surrogate(predicted)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
