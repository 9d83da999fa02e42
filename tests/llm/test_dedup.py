"""The three deduplicating operators against brute force, on whole small tables and on odd rows."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest

from showerlake.llm import filters, ngram_join, substring, suffix
from showerlake.llm.queries import table

ODD = [
    (1, None, "x"), (2, "", "x"), (3, "one two", None), (3, "one two", "x"), (None, "one two", "x"), (4, " ".join(f"w{i % 7}" for i in range(400)), "x"),
    (5, " ".join(f"v{i}" for i in range(300)), "x"), (6, " ".join(f"v{i}" for i in range(298)) + " end here", "x"), (None, " ".join(f"v{i}" for i in range(300)), "x"),
    (7, "aé" * 900, "x"), (8, "=" * 3000, "x"), (9, "x" + "=" * 500 + "é" * 300, "x"), (10, " ".join(f"v{i}" for i in range(100, 160)) + " tail", "x"), (5, " ".join(f"v{i}" for i in range(300)), "x"),
]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, did string")


def rows_of(spark, which, sf_dir):
    if which == "odd":
        return odd(spark)
    if which == "empty":
        return odd(spark).limit(0)
    return table(spark, sf_dir, "documents")


def split(text):
    return (text or "").encode().split()


def brute_substring(rows, window=13):
    first = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, 1 << 63), doc if doc is not None else (1 << 63) - 1)
    out = []
    for doc, text in rows:
        w = split(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (doc if doc is not None else (1 << 63) - 1):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_suffix(rows, length=400):
    seen = defaultdict(int)
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    for _, t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_join(rows, k=5, threshold=0.8):
    sets = []
    for _, text in rows:
        w = split(text)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    links = [set() for _ in rows]
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in inverted[x]:
                shared[j] += 1
        links[i] = {j for j, n in shared.items() if j != i and n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9}
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, near in enumerate(links):
        for j in near:
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), 1 << 63), doc)
    return [(doc, least.get(find(i)), len(links[i])) for i, (doc, _) in enumerate(rows)]


def sortable(rows):
    return sorted([tuple(r) for r in rows], key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


WHICH = ["odd", "empty", "table"]


@pytest.mark.parametrize("which", WHICH)
def test_substring(spark, sf_dir, which):
    docs = rows_of(spark, which, sf_dir)
    assert sortable(substring.without_repeats(docs, log_bits=18).collect()) == sortable(brute_substring(pairs(docs)))


@pytest.mark.parametrize("which", WHICH)
def test_suffix(spark, sf_dir, which):
    docs = rows_of(spark, which, sf_dir)
    got = suffix.without_repeats(docs.select("doc_id", "text"), log_bits=20).drop("_kept")
    assert sortable(got.collect()) == sortable(brute_suffix(pairs(docs)))


def test_suffix_of_large_groups(spark, sf_dir):
    docs = odd(spark)
    got = suffix.without_repeats(docs.select("doc_id", "text"), log_bits=20, group_bytes=0).drop("_kept")
    assert sortable(got.collect()) == sortable(brute_suffix(pairs(docs)))


@pytest.mark.parametrize("which", WHICH)
def test_join(spark, sf_dir, which):
    docs = rows_of(spark, which, sf_dir)
    got = ngram_join.joined(docs).select("doc_id", "class_id", "n_links")
    assert sortable(got.collect()) == sortable(brute_join(pairs(docs)))


def test_join_of_large_buckets_and_tiles(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(70):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, " ".join([f"y{i}_{j}" for j in range(150)] + base[:30])) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = ngram_join.joined(docs, small=8, tile=16).select("doc_id", "class_id", "n_links")
    assert sortable(got.collect()) == sortable(brute_join(texts))


def test_join_of_buckets_beyond_one_task(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        texts.append((i, " ".join(w)))
    # Similar to each other, but to no pivot but one of their own; and pairs of near copies among them.
    for i in range(40):
        own = [f"y{i // 2}_{j}" for j in range(60)]
        texts.append((1000 + i, " ".join(base + own + [f"z{i}"])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sortable(brute_join(texts))
    most = []
    whole = ngram_join.bounded_buckets

    def seen(*args):
        done, links = whole(*args)
        most.append((args[0].groupBy("path").count().agg({"count": "max"}).first()[0], done.groupBy("path").count().agg({"count": "max"}).first()[0] or 0))
        return done, links

    monkeypatch.setattr(ngram_join, "bounded_buckets", seen)
    for pivots, rounds in ((64, 3), (1, 1)):  # the second leaves tiles to be met
        monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
        monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", rounds)
        got = ngram_join.joined(docs, small=4, tile=16, large=8).select("doc_id", "class_id", "n_links")
        assert sortable(got.collect()) == want
        assert most[-1][0] > 30 and most[-1][1] <= 2 * 8 + 16


def test_suffix_array():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        raw = bytes(rng.choice(rng.choice([b"ab", b"a", b"abcdefgh"])) for _ in range(rng.randint(1, 100)))
        assert suffix.suffix_array(np.frombuffer(raw, np.uint8), len(raw) + 1).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_filter_loses_nothing():
    import numpy as np

    h = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    rows = list(filters._fill(iter([filters.by_slice(h, 12)]), 12))
    once = np.zeros((64, 8), np.uint8)
    for r in rows:
        for i, x in zip(r.column(0).to_pylist(), r.column(1).to_pylist()):
            once[i] = np.frombuffer(zlib.decompress(x), np.uint8)
    assert filters.test(once.reshape(-1), h).all()


@pytest.mark.skipif(not os.environ.get("TEST_LARGER"), reason="takes minutes")
def test_larger(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    rows = pairs(docs)
    assert sortable(substring.without_repeats(docs).collect()) == sortable(brute_substring(rows))
    assert sortable(ngram_join.joined(docs).select("doc_id", "class_id", "n_links").collect()) == sortable(brute_join(rows))
    assert sortable(suffix.without_repeats(docs.select("doc_id", "text")).drop("_kept").collect()) == sortable(brute_suffix(rows))
