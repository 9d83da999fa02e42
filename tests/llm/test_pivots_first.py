"""Large buckets of the n-gram join meet pivots before they are split."""

import random

from pyspark.sql import functions as F
from test_dedup import brute_join, sortable

from showerlake.llm import ngram_join


def texts():
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    found = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        found.append((i, " ".join(w)))
    # Half of the base, and near copies of each other by twos: no pivot of the group covers them.
    return found + [(1000 + i, " ".join(base[:60] + [f"y{i // 2}_{j}" for j in range(100)] + [f"z{i}"])) for i in range(40)]


def test_near_copies_are_not_split(spark, monkeypatch):
    rows, whole, split = texts(), ngram_join.leaf_buckets, []

    def seen(*args):
        out = whole(*args)
        split.append(0 if out[1] is None else out[1].count())
        return out

    monkeypatch.setattr(ngram_join, "leaf_buckets", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.joined(docs, small=4, tile=16, large=16, first=16).select("doc_id", "class_id", "n_links")
    assert sortable(got.collect()) == sortable(brute_join(rows))
    assert split and split[0] < 45  # sets in buckets that are split twice; 90 near copies and more before


def test_sets_that_pivots_leave(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = ngram_join.written(ngram_join.mapped(ngram_join.keyed(docs, F.col("doc_id").alias("_id")).select("did", "th", "text"), lambda b: ngram_join._described(b, 0.8), ngram_join.BASE), "sets")
    ids = {r["sh"]: r["did"] for r in base.select("sh", "did").collect()}
    big = base.select(F.lit(7).cast("long").alias("path"), "sh", F.lit(len(rows)).cast("long").alias("size"))
    left, links = ngram_join.met_by_pivots(big, base.select("sh", "sketch"), 16, 1)
    left, linked = left.collect(), {frozenset((r["u"], r["v"])) for r in links.collect()}
    assert all(r["size"] == len(left) for r in left)
    assert sum(ids[r["sh"]] < 1000 for r in left) < 20 and linked
