"""Scores, verdicts and the pipeline's stages against plain recomputations, and columns that clash with the operators' own names."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_dedup import ODD, brute_suffix, pairs
from test_operators import brute_rules
from test_pipeline import with_columns

import corpus_pipeline
from showerlake.llm import packing, quality, queries, rules, suffix, toxicity
from showerlake.llm.queries import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_features(text):
    """The features of quality.FEATURES, counted one by one."""
    raw, words = text.encode(), [w.encode() for w in WORD.findall(text)]
    n, lines = len(words), text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    size = max(1, len(raw))
    kinds = [sum(b in chars.encode() for b in raw) / size for chars in quality._KINDS.values()]
    grams = list(zip(words, words[1:], words[2:]))
    share = lambda k, of: k / max(1, of)
    blanks = sum(b in b" \t\n\x0b\x0c\r" for b in raw)
    return [
        float(np.log1p(n)), share(len(raw) - blanks, n), max(map(len, words), default=0), *kinds, raw.count(b"!") / size, share(sum(a == b for a, b in zip(words, words[1:])), n),
        share(len(set(words)), n), share(len(set(grams)), max(n - 2, 0)), share(len(set(lines)), len(lines)), share(n, len(lines)),
    ]


def plain_quality(model, text):
    if model.constant is not None:
        return model.constant
    x, f = plain_features(text), model.intercept
    place = lambda edges, v: sum(e <= v for e in edges)
    for v, edges, t in zip(x, model.edges, model.tables):
        f += t[place(edges, v)]
    for (i, j), t in zip(model.pairs, model.pair_tables):
        f += t[place(model.coarse[i], x[i]), place(model.coarse[j], x[j])]
    return 1 / (1 + math.exp(-f))


def test_quality_scores(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, "quality", ~queries.held_out(3, 1))
    rows = docs.unionByName(spark.createDataFrame([(d, t) for d, t, _ in ODD], "doc_id long, text string"))
    for r in quality.with_score(rows, model).collect():
        assert abs(r["_score"] - plain_quality(model, r["text"] or "")) < 1e-9, r["doc_id"]


def plain_toxicity(model, text):
    """Noisy-or over sentences, word by word."""
    from showerlake.llm.common import word_hashes

    if model.constant is not None:
        return model.constant
    one = lambda w: int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    miss = 1.0
    for sentence in re.split(rb"(?<=[.!?\n])", (text or "").encode()):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
        if words:
            z = model.bias
            for w in words:
                low = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
                z += weight.get(one(low), 0.0) + sum(weight.get((one(low[:k]) + k) % 2**64, 0.0) for k in toxicity.STEMS if len(low) > k)
            miss *= 1 / (1 + math.exp(z))
    return 1 - miss


def test_toxicity_scores(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "toxic", ~queries.held_out(5, 0))
    assert model.constant is None and len(model.words)
    rows = docs.limit(60).unionByName(spark.createDataFrame([(d, t) for d, t, _ in ODD], "doc_id long, text string"))
    texts = defaultdict(list)
    for r in rows.collect():
        texts[r["doc_id"]].append(plain_toxicity(model, r["text"]))
    got = defaultdict(list)
    for r in toxicity.scored(rows, model).collect():
        got[r["doc_id"]].append(r["score"])
    assert texts.keys() == got.keys()
    for k, want in texts.items():
        assert np.allclose(sorted(got[k]), sorted(want), atol=1e-9)


def plain_histograms(text, lang):
    upper, digit = sum(c.isupper() and c.lower() != c for c in text), sum(c.isdecimal() for c in text)
    words = WORD.findall(text)
    symbols, marks = sum(c in "#*$%&|<>" for c in text), sum(c in ".,;:!?'\"()-" for c in text)
    blanks = len(text) - sum(map(len, words))
    listed = [upper, digit, marks, symbols, blanks]
    common = rules.COMMON_WORDS.get(lang)
    seen = Counter(words)
    return [*listed, max(0, len(text) - sum(listed))], None if common is None else [*(seen[w] for w in common), len(words) - sum(seen[w] for w in common)]


def distance(p, q):
    return math.sqrt(max(0.0, sum(x * math.log2(2 * x / (x + y)) for a, b in ((p, q), (q, p)) for x, y in zip(a, b) if x > 0) / 2))


def test_rule_verdicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", "lang").collect()
    shares = lambda h: None if h is None else [x / sum(h) for x in h] if sum(h) else None
    base = {r["doc_id"]: brute_rules(r["text"]) for r in rows}
    hist = {r["doc_id"]: [shares(h) for h in plain_histograms(r["text"] or "", r["lang"])] for r in rows}
    mean = {}
    for lang in {r["lang"] for r in rows}:
        good = [hist[r["doc_id"]] for r in rows if r["lang"] == lang and not base[r["doc_id"]][-1]]
        mean[lang] = [None if not good or good[0][k] is None else np.mean([g[k] for g in good], axis=0) for k in (0, 1)]
    got = {r["doc_id"]: r for r in rules.judged(docs).collect()}
    assert got.keys() == base.keys() and any(not r["kept"] and not r["base_failed"] for r in got.values())
    for r in rows:
        n, failed = base[r["doc_id"]][0], base[r["doc_id"]][-1]
        far = [distance(hist[r["doc_id"]][k], mean[r["lang"]][k]) if n >= least and mean[r["lang"]][k] is not None else None for k, least in ((0, 50), (1, 100))]
        mine = got[r["doc_id"]]
        for a, b in zip((mine["class_distance"], mine["word_distance"]), far):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6), r["doc_id"]
        assert mine["kept"] == (not failed and (far[0] or 0) <= rules.MAX_CLASS_DISTANCE and (far[1] or 0) <= rules.MAX_WORD_DISTANCE)


CLASH = ("_text", "_score", "n_bytes", "n_removed", "n_spans", "kept_sha256", "_kept", "_row", "_own_0", "_doc", "did", "th", "size", "taken", "target", "ranges", "sh")


def test_clashing_columns(spark, sf_dir):
    docs = with_columns(spark, ODD)
    extra = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, more = stage(spark, docs, sf_dir), stage(spark, extra, sf_dir)
        assert more.columns == extra.columns
        some = more.select(*docs.columns)
        assert sorted(map(repr, some.collect())) == sorted(map(repr, plain.select(*docs.columns).collect())), name
        assert not more.filter(" OR ".join(f"NOT {c} <=> {i}" for i, c in enumerate(CLASH))).count()
    assert packing.pack_documents(extra, queries.tokenizer_path()).count() == packing.pack_documents(docs, queries.tokenizer_path()).count()
    assert rules.judged(extra).count() == toxicity.scored(extra, toxicity.NoisyOr(0.0)).count() == docs.count()


def test_texts_beyond_a_chunk(spark):
    rng = np.random.default_rng(0)
    long = " ".join(f"w{x}" for x in rng.integers(0, 100_000, 500_000))
    rows = [(1, long), (2, long[:1_000_000] + " other end"), (3, "short text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix.without_repeats(docs, log_bits=20, with_text=True).collect()}
    assert len(long) > 3 << 20 and got[1]["n_removed"] == got[2]["n_removed"] == 1_000_000 + (long[1_000_000] == " ") and got[3]["n_removed"] == 0
    assert got[1]["_kept"] == long[got[1]["n_removed"] :] and got[1]["kept_sha256"] == hashlib.sha256(got[1]["_kept"].encode()).hexdigest()


def test_pipeline_against_plain_stages(spark, sf_dir):
    """Each stage of a whole run, on what its predecessor kept; the join has its own test (test_pipeline)."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", ~queries.held_out(3, 1))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in good.collect()} == {d for d, t in pairs(docs) if plain_quality(model, t or "") >= 0.5}
    one = corpus_pipeline.written(stages["n-gram Jaccard join"](spark, good, sf_dir), "one")
    cut = corpus_pipeline.written(stages["suffix-array dedup"](spark, one, sf_dir), "cut")
    want = {d: sha for d, n, removed, _, sha in brute_suffix(pairs(one), corpus_pipeline.REPEAT_BYTES) if removed < n or not n}
    got = {r["doc_id"]: r for r in cut.collect()}
    whole = {d: (t or "").encode() for d, t in pairs(one)}
    assert want.keys() >= got.keys() and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert not [d for d in want.keys() - got.keys() if whole[d].isascii()]  # what is left of a cut character may be nothing
    for d, sha in want.items():
        if d in got and hashlib.sha256(got[d]["text"].encode()).hexdigest() != sha:
            assert not whole[d].isascii() and len(got[d]["text"].encode()) < len(whole[d])
    mixed = corpus_pipeline.written(stages["mixing sources to target weights"](spark, cut, sf_dir), "mixed")
    taken, size = Counter(), {d: len(WORD.findall(r["text"])) for d, r in got.items()}
    for d, t in pairs(mixed):
        taken[d] += len(WORD.findall(t))
        assert got[d]["text"].startswith(t)
    assert all(n <= 2 * size[d] for d, n in taken.items()) and abs(sum(taken.values()) / (1.5 * sum(size.values())) - 1) < 0.05
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    packed = stages["packing"](spark, mixed, sf_dir)
    tokens = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in pairs(mixed))
    assert packed.agg(F.sum("length")).first()[0] == tokens
