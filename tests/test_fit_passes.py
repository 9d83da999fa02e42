"""What a pass of boosted fits reads."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from showerlake.operators import boosting
from showerlake.operators import models as md
from showerlake.plans import tables
from showerlake.sources.fixtures import fixture


def test_a_block_holds_one_fold_and_the_models_that_learn_from_it():
    rng = np.random.default_rng(4)
    x, y, fold = rng.uniform(0, 1, (60, 2)), rng.normal(size=(60, 2)), rng.integers(-1, 4, 60).astype(np.int32)
    model = boosting.Boosted(("a", "b"), ("y", "z"), (0, 2), 3, [np.array([0.3, 0.6]), np.array([0.5])], np.arange(4.0))
    batches = [pa.RecordBatch.from_arrays([pa.array(fold[s]), pa.array(list(x[s])), pa.array(list(y[s]))], ["fold", "x", "y"]) for s in (slice(0, 25), slice(25, 60))]
    blocks = list(boosting._blocks(model, boosting._coded(model)(iter(batches))))
    assert sorted(k for k, *_ in blocks) == [-1, 0, 2]
    for k, codes, models, rest in blocks:
        mine = ~np.isin(fold, (0, 2)) if k == -1 else fold == k
        assert models.tolist() == [m for m, (_, out) in enumerate(model.kinds) if out != k]
        assert np.array_equal(codes, model.codes(x[mine]))
        assert np.array_equal(rest, np.stack([y[mine][:, m // 2] - model.base[m] for m in models]))


def test_a_fit_reads_small_batches_and_leaves_the_session_as_it_was(spark, monkeypatch):
    key, seen, gathered = "spark.sql.execution.arrow.maxBytesPerBatch", [], boosting._gathered
    monkeypatch.setattr(boosting, "_gathered", lambda *a: seen.append(int(spark.conf.get(key))) or gathered(*a))
    before = spark.conf.get(key)
    df = spark.range(30).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("y"))
    boosting.fit(df, F.col("id") % 3, ("a",), ("y",), (0,), trees=1)
    assert seen and max(seen) <= boosting.BATCH_BYTES and spark.conf.get(key) == before


def test_the_model_table_has_what_fits_need(spark, sf_dir):
    c = fixture(spark, sf_dir)
    new = tables.modelled(c)
    assert new.columns == ["event_number", *md.FEATURES, *md.OUTPUTS]
    old = tables.table(c).join(c.singles.select("event_number", "theta", "phi"), "event_number").select(*new.columns)
    near = lambda df: df.select("event_number", *[F.round(F.col(n).cast("double"), 9).alias(n) for n in new.columns[1:]])
    assert new.count() == old.count() and near(new).exceptAll(near(old)).isEmpty()
