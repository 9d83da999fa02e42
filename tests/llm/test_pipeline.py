"""The pipeline, stage by stage, on odd rows and on a whole small table."""

from test_dedup import ODD, brute_join, odd, pairs  # noqa: F401

import corpus_pipeline
from showerlake.llm.queries import table


def with_columns(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_odd_rows(spark, sf_dir):
    for rows in (ODD, []):
        docs = with_columns(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, sf_dir)
            if name != "packing":
                assert sorted(after.columns) == sorted(docs.columns)
                docs = after.select(*docs.columns).cache()
                docs.count()
        assert after.count() >= 0


def test_one_of_each(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, sf_dir).collect()}
    assert kept == {c for _, c, _ in brute_join(pairs(docs))}


def test_one_of_each_odd(spark, sf_dir):
    kept = corpus_pipeline.keep_one_of_each(spark, with_columns(spark, ODD), sf_dir).collect()
    texts = [(r["doc_id"], (r["text"] or "")[:8]) for r in kept]
    assert sum(not t for _, t in texts) == 2 and len([1 for d, t in texts if t == "one two"]) == 1


def test_whole(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > n / 10
