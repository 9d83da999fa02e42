"""Bounds on what a worker holds: batches in bytes, shingles of one text at once, what the tokenizer keeps."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from showerlake.llm import common, ngram_join, packing
from showerlake.llm.queries import tokenizer_path


@pytest.mark.parametrize("before, after", [("67108864b", common.ARROW_BYTES), ("64m", common.ARROW_BYTES), ("1m", 1 << 20)])
def test_batches_are_bounded_in_bytes(spark, before, after):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, before)
    docs = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = common.mapped(docs, lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    assert common._bytes(spark.conf.get(key)) == after
    found = [r["n"] for r in sizes.collect()]
    spark.conf.set(key, was)
    assert sum(found) >= 60 << 20 and max(found) <= after + (2 << 20)


def test_shingles_of_a_text_in_steps(monkeypatch):
    texts = pa.RecordBatch.from_pydict({"did": [1, 2, 3], "th": [1, 2, 3], "text": [" ".join(str(i * i) for i in range(900)), "", "a b c d e f"]})
    whole = [b.to_pydict() for b in ngram_join._described(iter([texts]), 0.8)]
    monkeypatch.setattr(ngram_join, "SAMPLED_AT_ONCE", 7)
    assert [b.to_pydict() for b in ngram_join._described(iter([texts]), 0.8)] == whole


def test_tokenizer_keeps_little_and_not_for_long(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_SECONDS", 0.2)
    path, texts = tokenizer_path(), ["plain words " * 3, "x" * 5_000 + " tail", "", "9" * 500]
    first = packing.token_ids(texts, path)
    kept = packing._ENCODERS[path]
    assert max(map(len, kept.parts)) <= packing._LONGEST_KEPT and max(map(len, kept.pieces)) <= packing._LONGEST_KEPT and "plain" in kept.parts
    for text, ids in zip(texts, first, strict=True):
        assert ids.tolist() == kept.tokenizer.encode(text, add_special_tokens=False).ids
    time.sleep(1)
    assert not packing._ENCODERS
    assert all(np.array_equal(a, b) for a, b in zip(first, packing.token_ids(texts, path), strict=True))


def test_ids_of_any_characters():
    """Parts of drawn characters get the tokenizer's own ids: letters whose lower case is longer, marks, special tokens in any case."""
    rng = random.Random(5)
    path = tokenizer_path()
    drawn = [chr(c) for c in range(1, 0x180)] + list("İıſŉ'<|>̇́Σ中   \n") + ["<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL"]
    texts = ["".join(rng.choices(drawn, k=rng.randint(0, 12))) for _ in range(5_000)] + [a + b for a in drawn[:390] for b in "aZ1'İ"]
    encoder = packing.Encoder(path)
    for text, ids in zip(texts, packing.token_ids(texts, path), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    """A file with other settings doesn't get the short cut, and so gets its own ids too."""
    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["Plain WORDS, don't  split\tapart\n", "", "\u0130x 12345 e\u0301", "a" * 3000]
    encoder = packing.Encoder(path)
    assert not encoder.apart and packing.Encoder(tokenizer_path()).apart
    for text, ids in zip(texts, packing.token_ids(texts, path), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
