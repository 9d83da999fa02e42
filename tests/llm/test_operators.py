"""The other operators: against their SQL, brute force, an exact round trip or held-out accuracy; and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import ODD, odd

from showerlake.llm import ann, chat, mixing, packing, quality, queries, rules, toxicity
from showerlake.llm.queries import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = [tuple(r[columns.index(c)] for c in df.columns) for r in cur.fetchall()]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


def test_chat_round_trip():
    t = chat.Template()
    for role, text in (("user", "</s>[INST] ok [/INST]"), ("assistant", "\\[ANS]\\\\ <s>"), ("odd] \\role", "[ROLE x] [/ROLE] <"), ("", ""), ("system", "[SY[SYS]S]")):
        whole = "".join(s for s, _ in t.turn(role, text))
        inside = t.escape(text)
        assert t.unescape(inside) == text and not any(c in inside for c in t.control)
        m = t.reader().fullmatch(whole)
        known = [i for i, r in enumerate(t.marks) if m[f"r{i}"] is not None]
        assert (list(t.marks)[known[0]], t.unescape(m[f"t{known[0]}"])) == (role, text) if known else (t.unescape(m["name"]), t.unescape(m["t"])) == (role, text)


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None, 5), (1, 1, "user", "b", 5), (None, 0, None, "x", 5), (2, None, "tool", "y" * 100000, 5), (1, 1, "user", "b", 5)]
    for some in (rows, []):
        df = spark.createDataFrame(some, "conv_id long, turn long, role string, text string, error int")
        got = {r["conv_id"]: r for r in chat.chat_digests(chat.chat_segments(df)).collect()}
        by = defaultdict(list)
        for conv, turn, role, text, _ in some:
            by[conv].append((-1 if turn is None else turn, role or "", text or ""))
        assert got.keys() == by.keys()
        for conv, turns in by.items():
            turns.sort()
            assert got[conv]["n_turns"] == len(turns)
            assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    for docs in (table(spark, sf_dir, "documents").limit(120), odd(spark), odd(spark).limit(0)):
        texts = Counter()
        want = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
            want[r["doc_id"]].append(ids)
            texts[r["doc_id"]] += len(ids)
        got = packing.pack_documents(docs, queries.tokenizer_path(), with_ids=True).collect()
        total, room = Counter(), defaultdict(list)
        for r in got:
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
            assert any(len(w) == r["doc_tokens"] and (w[r["start"] : r["start"] + r["length"]] == r["ids"]).all() for w in want[r["doc_id"]])
            total[r["doc_id"]] += r["length"]
            room[r["sequence_id"]].append((r["offset"], r["length"]))
        assert total == texts
        for pieces in room.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def brute_rules(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_rules(spark, sf_dir):
    extra = [("a b c a b c a\n" * 3 + " \n\n" + "q#r " * 30), "x\x1cy z w", "a a a a"]
    odd_docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(extra)] + [(None, t, None) for _, t, _ in ODD], "doc_id long, text string, lang string")
    for docs in (table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), odd_docs, odd_docs.limit(0)):
        got = sorted(repr(tuple(r)) for r in rules.judged(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
        assert got == sorted(repr(brute_rules(r["text"])) for r in docs.collect())
        assert rules.judged(docs).filter("kept AND base_failed").count() == 0


def test_mixing_targets(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 10)] * 50 + [("b", 30)] * 40 + [(None, 7)] * 300 + [("z", 0)] * 3 + [("c", 5000)])]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.taken_words(df, rows_per_shard=20).collect()
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    order = sorted((s for s in size), key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_ = {}, set(order)
    total = 1.5 * sum(size.values())
    while True:
        left = total - sum(2 * size[s] for s in order if s not in open_)
        want = {s: left * weight[s] / sum(weight[x] for x in open_) if s in open_ else 2 * size[s] for s in order}
        over = {s for s in open_ if want[s] > 2 * size[s]}
        if not over:
            break
        open_ -= over
    for s in order:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert abs(taken[s] - target[s]) <= 0.002 * total / 3 + 5
    assert mixing.taken_words(df.limit(0)).count() == 0


def test_mixing_of_small_sources_and_full_shards(spark):
    rows = [(i, "big", 1_000_000) for i in range(1000)] + [(5000, "small", 12), (5001, "small", 8)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = {r["source"]: r for r in mixing.taken_words(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert got["small"]["target"] == 40 and got["small"]["taken"] == 40
    # A shard for each document. Source a may repeat whole; c has a shard far smaller than the others.
    for n in (3000, 20):
        rows = [(i, "c", 400 + i % 37) for i in range(n)] + [(n, "c", 3)]
        rows += [(10_000 + i, "a", 300 + 7 * (i % 50)) for i in range(n)]
        rows += [(20_000 + i, "b", 2_000) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, source string, size long")
        by = mixing.taken_words(df, rows_per_shard=1)
        assert by.filter("taken > 2 * size").count() == 0 and by.filter("source in ('a', 'c') and taken = 0").count() == 0
        for r in by.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
            assert abs(r["taken"] - r["target"]) <= 0.002 * r["target"], r


def test_nearest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(300, 24)))]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), 20, query_block=7, candidate_block=50).collect()
    good = {i: np.array(v, np.float64) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    want = []
    for q in sorted(good):
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
            want += [(q, k, i) for k, (_, i) in enumerate(near, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(want)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_classifiers_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = table(spark, d, "labels")
    for name, label, least in (("op1_toxicity", "toxic", 0.85), ("op2_quality_classifier", "quality", 0.95)):
        got = queries.QUERIES[name](spark, d)
        assert got.count() == table(spark, d, "documents").count() and got.filter("score BETWEEN 0 AND 1").count() == got.count()
        met = got.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a")).first()
        assert met["a"] >= least


def test_classifiers_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(6, 0, 1), (5, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        assert toxicity.scored(docs, toxicity.fit(docs, some, "toxic", F.lit(True))).count() == docs.count()
        assert quality.with_score(docs, quality.fit(docs, some, "quality", F.lit(True))).count() == docs.count()
    found = toxicity.scored(docs.filter("doc_id < 3"), toxicity.NoisyOr(0.0)).collect()
    assert all(r["score"] == 0 and r["n_sentences"] == 0 for r in found)


def test_toxicity_locates(spark):
    calm, rude = "all is well here. the day is fine", "all is well here. you awful fool. the day is fine"
    docs = spark.createDataFrame([(i, rude if i % 2 else calm) for i in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = toxicity.scored(docs, toxicity.fit(docs, labels, "toxic", F.lit(True))).collect()
    for r in got:
        assert (r["score"] >= 0.5) == bool(r["doc_id"] % 2)
        assert [rude[s["start"] : s["end"]] for s in r["offending"]] == ([" you awful fool."] if r["doc_id"] % 2 else [])


def test_additive_model_is_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) >= 0.5) == y) > 0.9
