"""Tables and shuffles of a stage go as soon as nothing reads them any more."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from showerlake.llm import mixing
from showerlake.llm.common import settled, shared_dir, table, written
from showerlake.sources.shared import shuffles_dropped

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tables(spark):
    top = shared_dir(spark).removeprefix("file://") + "/tables"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_settled_leaves_its_rows_alone(spark):
    before = tables(spark)
    outer = settled(spark, "outer", lambda: settled(spark, "inner", lambda: written(spark.range(7).toDF("i"), "first")).withColumn("j", F.col("i") * 2))
    assert {r["i"]: r["j"] for r in outer.collect()} == {i: 2 * i for i in range(7)}
    assert [n.split("-")[0] for n in tables(spark) - before] == ["outer"]

    def fails():
        written(spark.range(3), "lost")
        raise KeyError("no")

    with pytest.raises(KeyError):
        settled(spark, "outer", fails)
    assert len(tables(spark) - before) == 1 and written(spark.range(3), "kept").count() == 3 and len(tables(spark) - before) == 2


def test_shuffles_go_with_their_query(spark):
    was = spark.conf.get(CLEANUP)
    with shuffles_dropped(spark):
        assert spark.conf.get(CLEANUP) == "true"
        df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        assert df.collect() and sum(r["count"] for r in df.collect()) == 1000  # shuffled anew
    assert spark.conf.get(CLEANUP) == was


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] in ("n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights")], ids=lambda s: s[0])
def test_a_stage_leaves_one_small_table(spark, sf_dir, stage):
    before = tables(spark)
    assert stage[1](spark, table(spark, sf_dir, "documents"), sf_dir).count()
    assert len(tables(spark) - before) == 1


def test_the_pipeline_keeps_the_last_result_alone(spark, sf_dir):
    before = tables(spark)
    corpus_pipeline.run(spark, sf_dir)
    left = tables(spark) - before
    assert len(left) == 1 and left.pop().startswith("mixing")


def test_texts_are_dealt_once_to_be_mixed(spark):
    rows = [(1, "one two three", "a"), (1, "one two three", "a"), (None, "four five", "a"), (None, "four five", "b"), (2, None, "b")]
    docs = spark.createDataFrame([(*r, 3) for r in rows * 4], "doc_id long, text string, source string, n_chars long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = mixing.mix_documents(docs)
        df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    words = [(r["doc_id"], r["source"], len(r["text"].split())) for r in df.collect()]
    assert {(i, s) for i, s, _ in words} == {(1, "a"), (None, "a"), (None, "b")} and sum(n for *_, n in words) == 60
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    dealt = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert len(dealt) == 2 and all("_row" in d and "_id" in d for d in dealt), dealt
