"""Trees grown in step against a plain booster, one model at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerlake.operators import boosting

NAMES, OUTPUTS, FOLDS = ("a", "b", "c"), ("y", "z"), (0, 2)


def data(n=400):
    rng = np.random.default_rng(6)
    x = np.stack([rng.normal(0, 1, n), rng.integers(0, 5, n).astype(float), rng.exponential(1, n)], 1)
    y = np.stack([np.sin(2 * x[:, 0]) + x[:, 1] + 0.1 * rng.normal(0, 1, n), x[:, 2] ** 2 - x[:, 0]], 1)
    return x, y, np.arange(n) % 3


def plain(x, y, train, edges, trees, rate, depth):
    """(predictions of all rows, gain of each feature) of one model; every cut of every node is tried in turn."""
    codes = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)
    score, gains = np.full(len(x), y[train].mean()), np.zeros(x.shape[1])
    for _ in range(trees):
        rest, at = y - score, {(): np.ones(len(x), bool)}
        for _ in range(depth):
            below = {}
            for path, mask in at.items():
                best, r = (0.0, None), rest[mask & train]
                for j in range(x.shape[1]):
                    for b in range(int(codes[:, j].max())):
                        left = codes[mask & train, j] <= b
                        if 0 < left.sum() < len(left):
                            gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r)
                            if gain > best[0] + 1e-9:
                                best = (gain, (j, b))
                if best[1] is None:
                    below[path + (0,)] = mask
                    continue
                j, b = best[1]
                gains[j] += best[0]
                below[path + (0,)], below[path + (1,)] = mask & (codes[:, j] <= b), mask & (codes[:, j] > b)
            at = below
        for mask in at.values():
            if (mask & train).any():
                score[mask] += rate * rest[mask & train].mean()
    return score, gains


@pytest.mark.parametrize("kept, parts", [(10, 64), (2, 1)])
def test_models_in_step(spark, monkeypatch, kept, parts):
    monkeypatch.setattr(boosting, "KEPT_TREES", kept)
    monkeypatch.setattr(boosting, "MOST_PARTS", parts)
    x, y, fold = data()
    df = spark.createDataFrame([(i, *map(float, x[i]), *map(float, y[i])) for i in range(len(x))], "i int, a double, b double, c double, y double, z double").repartition(5)
    model = boosting.fit(df, F.col("i") % 3, NAMES, OUTPUTS, FOLDS, trees=6, rate=0.3, depth=3, bins=8)
    assert all(np.array_equal(e, np.unique(np.quantile(x[:, j], np.arange(1, 8) / 8))) or np.allclose(e, np.unique(np.quantile(x[:, j], np.arange(1, 8) / 8))) for j, e in enumerate(model.edges))
    got = {(r["i"], r["fold"]): r for r in boosting.predicted(model, df, F.col("i") % 3).collect()}
    assert set(got) == {(i, i % 3) for i in range(len(x)) if i % 3 in FOLDS}
    for o, name in enumerate(OUTPUTS):
        for k in FOLDS:
            want, gains = plain(x, y[:, o], fold != k, model.edges, 6, 0.3, 3)
            mine = [i for i in range(len(x)) if i % 3 == k]
            assert np.allclose([got[i, k][f"pred_{name}"] for i in mine], want[mine], atol=1e-9)
            assert np.allclose([g for _, g in model.importance()[name, k]], gains / gains.sum(), atol=1e-9)


def test_nulls_constant_features_and_empty(spark):
    rows = [(i, None if i % 4 else float(i), 1.0, float(i % 2), float(i)) for i in range(40)] + [(99, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double")
    model = boosting.fit(df, F.col("i") % 5, NAMES, ("y",), (0, 1), trees=3)
    found = boosting.predicted(model, df, F.col("i") % 5).collect()
    assert len(found) == 16 and all(np.isfinite(r["pred_y"]) for r in found) and model.importance()["y", 0][1] == ("b", 0.0)
    none = boosting.fit(df.filter("i < 0"), F.col("i") % 5, NAMES, ("y",), (0,), trees=2)
    assert boosting.predicted(none, df.filter("i < 0"), F.col("i") % 5).count() == 0 and none.base.tolist() == [0.0]


def test_a_pass_below_the_root_looks_at_the_lesser_children(spark, monkeypatch):
    seen, gathered = [], boosting._gathered
    monkeypatch.setattr(boosting, "_gathered", lambda *a: seen.append(gathered(*a)) or seen[-1])
    x, y, fold = data()
    df = spark.createDataFrame([(i, *map(float, x[i]), *map(float, y[i])) for i in range(len(x))], "i int, a double, b double, c double, y double, z double")
    boosting.fit(df, F.col("i") % 3, NAMES, OUTPUTS, FOLDS, trees=2, depth=3, bins=8)
    models, wide = len(OUTPUTS) * len(FOLDS), len(NAMES) * 9
    assert [s.size for s in seen] == [2 * models * wide, 2 * models * wide, 4 * models * wide, models * wide, 2 * models * wide, 4 * models * wide]
    for level in (1, 2, 4, 5):
        rows = seen[level].reshape(2, models, -1)[1].sum(-1) / len(NAMES)
        assert (rows <= [np.sum(fold != k) / 2 for _ in OUTPUTS for k in FOLDS]).all()
