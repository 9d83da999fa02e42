"""Texts longer than a worker's chunk, repeated ids and clashing columns, and the join's recall on a larger table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute import plain_quality
from test_dedup import brute_join, brute_substring, pairs, sortable
from test_operators import brute_rules

from showerlake.llm import ann, common, mixing, ngram_join, packing, quality, queries, rules, substring, toxicity
from showerlake.llm.queries import table


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(10, 24))) for _ in range(3_000)]
    texts = [" ".join(rng.choice(words) + (".\n" if rng.random() < 0.05 else "") for _ in range(140_000)) for _ in range(2)]
    assert all(len(t.encode()) > common.CHUNK_BYTES for t in texts)
    other = texts[0].split(" ")
    other[70_000:70_050] = ["changed"] * 50
    return [(1, texts[0]), (2, texts[1]), (3, " ".join(other)), (4, " ".join(texts[1].split(" ")[60_000:60_400])), (5, "short text"), (6, "")]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    return spark.createDataFrame([(d, t, "en") for d, t in long_texts], "doc_id long, text string, lang string").persist()


def test_quality(spark, sf_dir, long_docs):
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", ~queries.held_out(3, 1))
    for r in quality.with_score(long_docs.filter("doc_id <> 3"), model).collect():
        assert abs(r["_score"] - plain_quality(model, r["text"])) < 1e-9, r["doc_id"]


def test_toxicity(spark, sf_dir, long_texts):
    """The noisy-or of a text is that of its parts, cut between sentences, wherever chunks end."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "toxic", ~queries.held_out(5, 0))
    bad = docs.join(labels.filter("toxic = 1"), "doc_id").first()["text"]
    text = long_texts[0][1] + "\n" + bad
    cut = text.index("\n", len(text) // 2) + 1
    rows = spark.createDataFrame([(1, text), (2, text[:cut]), (3, text[cut:]), (4, bad)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(rows, model).collect()}
    assert abs((1 - got[1]) - (1 - got[2]) * (1 - got[3])) < 1e-9 and got[1] >= got[4] - 1e-12


def test_rules(long_docs):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rules.judged(long_docs).collect()}
    assert got == {r["doc_id"]: brute_rules(r["text"]) for r in long_docs.collect()}


def test_join(long_docs, long_texts):
    got = ngram_join.joined(long_docs.select("doc_id", "text")).select("doc_id", "class_id", "n_links").collect()
    assert sortable(got) == sortable(brute_join(long_texts)) and {r["class_id"] for r in got if r["doc_id"] in (1, 3)} == {1}


def test_substring(long_docs, long_texts):
    assert sortable(substring.without_repeats(long_docs.select("doc_id", "text"), log_bits=24).collect()) == sortable(brute_substring(long_texts))


def test_packing(long_docs, long_texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = packing.pack_documents(long_docs.filter("doc_id IN (1, 4)"), queries.tokenizer_path(), with_ids=True).collect()
    for d, text in long_texts:
        if d in (1, 4):
            mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
            assert [i for r in mine for i in r["ids"]] == [*tok.encode(text, add_special_tokens=False).ids, 2]
            assert all(a["start"] + a["length"] == b["start"] for a, b in zip(mine, mine[1:]))


def test_nearest_with_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    base = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(60, 8)))]
    again = base[20:23] + [(21, base[40][1])]  # the same rows again, and another vector of an id
    df = spark.createDataFrame(base + again, "vec_id long, embedding array<float>")
    more = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("v", "copy", "qb", "cb", "score", "rank", "query_id"))])
    found = [ann.nearest(d, d.filter("vec_id % 20 = 0"), 5, query_block=2, candidate_block=16).collect() for d in (df, more)]
    assert sortable(found[0]) == sortable(found[1])
    good = [(i, np.array(v, np.float64)) for i, v in base + again]
    for q in (0, 40):
        v = dict(good[:60])[q]
        want = sorted(((-float(sum(a * b for a, b in zip(v, w))), i) for i, w in good if i != q))[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted(found[0], key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, -s) for s, i in want]
    assert {(r["query_id"], r["rank"]) for r in found[0]} == {(q, k) for q in (0, 20, 40) for k in range(1, 6)}


def test_mixing_of_null_repeated_and_spaced_ids(spark):
    rng = random.Random(1)
    rows = [(None, "a", rng.randint(1, 400)) for _ in range(2000)] + [(7, "b", rng.randint(1, 400)) for _ in range(2000)] + [(20 * i, None, rng.randint(1, 400)) for i in range(2000)] + [(3, "b", 0), (4, "e", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.taken_words(df, rows_per_shard=200).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n"), F.count_if(F.col("taken") > 2 * F.col("size")).alias("over"))
    got = {r["source"]: r for r in out.collect()}
    assert {k: r["n"] for k, r in got.items()} == {"a": 2000, "b": 2001, None: 2000, "e": 1} and not any(r["over"] for r in got.values())
    for k in ("a", "b", None):
        assert abs(got[k]["taken"] - got[k]["target"]) <= 0.005 * got[k]["target"], got[k]
    assert got["e"]["taken"] == 0


def test_join_recall_on_a_larger_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert sortable(ngram_join.joined(docs).select("doc_id", "class_id", "n_links").collect()) == sortable(brute_join(pairs(docs)))
