"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence has a score from its words; the document's score is their noisy-or, the
chance that one sentence at least is toxic. The word weights are trained from labels of whole
documents, and the sentence scores then locate what offends.

The model is fitted on at most about `per_label` documents of each label, chosen by a hash
of doc_id and weighted back to the labels' true shares; everything else covers all rows. Only what is learned from goes to the driver. A word is a run of ASCII letters and
digits and of bytes of other scripts, ASCII case ignored; sentences end at . ! ? and line ends. Beside a word
its beginnings of 4 to 8 bytes count, since a stem may have more endings than the sample shows.
Null and empty texts have no sentence and score 0; a text beyond one chunk is scored like any other. Other columns are
not looked at, whatever their names. Repeated rows get equal scores.
Without labels of both kinds every text scores the share of label 1 (0 if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LITTLE, U64, filled, mapped, signed, text_chunks, text_column, word_hashes, written
from .quality import labelled_sample

PER_LABEL = 2_000
STEMS = (4, 5, 6, 7, 8)
#: A feature is learned from this many documents on, if their labels differ from the others' by so many deviations.
MIN_DOCUMENTS, MIN_DEVIATIONS = 8, 3.0
STEPS, RATE, RIDGE = 200, 0.1, 2e-4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash and sentence of every word and stem; start byte, end byte and text of every sentence that has a word."""
    inside = _LETTER[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = _LOWER[data]
    h = [word_hashes(low, starts, ends)]
    breaks = np.union1d(np.flatnonzero(_END[data]) + 1, offsets[:-1])
    breaks = np.append(breaks[breaks < len(data)], len(data))
    part = np.searchsorted(breaks, starts, "right") - 1
    used, word_sentence = np.unique(part, return_inverse=True)
    of = [word_sentence]
    for k in STEMS:
        longer = ends - starts > k
        h.append(word_hashes(low, starts[longer], starts[longer] + k) + U64(k))
        of.append(word_sentence[longer])
    return np.concatenate(h), np.concatenate(of), breaks[used], breaks[used + 1] if len(used) else used, np.searchsorted(offsets, breaks[used], "right") - 1


class NoisyOr:
    """Sorted word hashes with their weights, and the bias of a sentence."""

    def __init__(self, share: float):
        self.constant: float | None = share
        self.words, self.weights, self.bias = np.zeros(0, U64), np.zeros(0), 0.0

    @classmethod
    def trained(cls, words: np.ndarray, sentence: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> NoisyOr:
        """words: hashes of what is learned from; sentence: of each; owner: document of each sentence; y, weight: of each document."""
        share = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
        model = cls(share)
        if not 0 < share < 1:
            return model
        known, code = np.unique(words, return_inverse=True)
        params, m, v = np.zeros(len(known) + 1), 0.0, 0.0
        params[-1] = np.log(share / (1 - share)) - 3
        weight = weight / weight.sum()
        for step in range(1, STEPS + 1):
            z = params[-1] + np.bincount(sentence, params[code], len(owner))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            miss = np.exp(-np.bincount(owner, np.logaddexp(0, z), len(y)))  # chance that no sentence is toxic
            slope = weight * np.where(y == 1, -miss / np.maximum(1 - miss, 1e-6), 1.0)
            dz = slope[owner] * p
            grad = np.append(np.bincount(code, dz[sentence], len(params) - 1) + RIDGE * params[:-1], dz.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            params -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.constant, model.words, model.weights, model.bias = None, known, params[:-1], float(params[-1])
        model.may_be = np.zeros(1 << 16, bool)
        model.may_be[(model.words >> U64(48)).astype(np.int64)] = True
        return model

    def sentence_scores(self, h: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        if not len(self.words):
            return np.full(n, self.bias)
        near = np.flatnonzero(self.may_be[(h >> U64(48)).astype(np.int64)])
        h, sentence = h[near], sentence[near]
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return self.bias + np.bincount(sentence, np.where(self.words[at] == h, self.weights[at], 0.0), n)


SCORED = "doc_id long, score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def _scored(batches: Iterator[pa.RecordBatch], model: NoisyOr, located: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, end, data, offsets in text_chunks(filled(batch), LITTLE):
            n = end - first
            h, sentence, starts, ends, owner = sentences(data, offsets)
            z = model.sentence_scores(h, sentence, len(starts))
            score = 1 - np.exp(-np.bincount(owner, np.logaddexp(0, z), n)) if model.constant is None else np.full(n, model.constant)
            p = 1 / (1 + np.exp(-z))
            bad = np.flatnonzero(p >= located) if model.constant is None else np.zeros(0, np.int64)
            spans: list[list] = [[] for _ in range(n)]
            if len(bad):
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # places are counted in characters
                for i in bad:
                    at = chars[offsets[owner[i]]]
                    spans[owner[i]].append({"start": int(chars[starts[i]] - at), "end": int(chars[ends[i]] - at), "score": float(p[i])})
            yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(first, n), "score": score, "n_sentences": np.bincount(owner, minlength=n).astype(np.int32), "offending": pa.array(spans, pa.list_(_SPAN))})


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word or stem and label: how many texts of the batch hold it."""
    for batch in batches:
        y = batch.column(batch.schema.get_field_index("y")).to_numpy()
        for first, _, data, offsets in text_chunks(filled(batch), LITTLE):
            h, sentence, _, _, owner = sentences(data, offsets)
            doc = owner[sentence]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.concatenate([h[:1] == h[:1], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
            h, toxic = h[new], y[first + doc[new]] == 1
            head = np.flatnonzero(np.concatenate([h[:1] == h[:1], h[1:] != h[:-1]]))
            n, n1 = (np.add.reduceat(x.astype(np.int64), head) if len(head) else np.zeros(0, np.int64) for x in (np.ones(len(h)), toxic))
            yield pa.RecordBatch.from_pydict({"h": signed(h[head]), "n0": n - n1, "n1": n1})


def learned(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the words and stems that MIN_DOCUMENTS of the sample's texts hold, and whose share differs between the
    labels by MIN_DEVIATIONS. They come to the driver: what a bounded sample can hold so often is bounded."""
    n = [F.greatest(F.lit(1), F.count_if(F.col("y") == v)).alias(f"t{v}") for v in (0, 1)]
    seen = mapped(sample.select("text", "y"), _seen, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    seen = seen.filter(F.col("n0") + F.col("n1") >= MIN_DOCUMENTS).crossJoin(F.broadcast(sample.agg(*n)))  # one row of totals
    both = (F.col("n0") + F.col("n1")) / (F.col("t0") + F.col("t1"))
    spread = F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * (1 / F.col("t0") + 1 / F.col("t1")))
    found = seen.filter(F.abs(F.col("n1") / F.col("t1") - F.col("n0") / F.col("t0")) >= MIN_DEVIATIONS * spread).select("h").toPandas()
    return np.sort(found["h"].to_numpy(np.int64).view(U64))


def _bags(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each text of the sample: its known words, the sentence of each, and how many sentences it has."""
    for batch in batches:
        y = batch.column(batch.schema.get_field_index("y")).to_numpy()
        ids = batch.column(0).to_numpy()
        for first, end, data, offsets in text_chunks(filled(batch), LITTLE):
            h, sentence, _, _, owner = sentences(data, offsets)
            keep = np.isin(h, known)
            h, sentence = h[keep], sentence[keep]
            order = np.argsort(sentence, kind="stable")
            h, sentence = h[order], sentence[order]
            docs = np.arange(end - first + 1)
            cut, base = np.searchsorted(owner[sentence], docs), np.searchsorted(owner, docs)
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids[first:end], "y": pa.array(y[first:end], pa.int32()), "n": pa.array(np.diff(base), pa.int32()),
                "words": pa.array([signed(x) for x in np.split(h, cut[1:-1])], pa.list_(pa.int64())),
                "sentence": pa.array([(x - b).astype(np.int32) for x, b in zip(np.split(sentence, cut[1:-1]), base, strict=False)], pa.list_(pa.int32())),
            })


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_label: int = PER_LABEL) -> NoisyOr:
    sample, stands_for = labelled_sample(docs, labels, label, usable, per_label, by_class=True)
    sample = written(sample, "toxicity-sample")
    known = learned(sample)
    rows = mapped(sample.select(F.col("doc_id").cast("long"), "text", "y"), lambda b: _bags(b, known), "doc_id long, y int, n int, words array<long>, sentence array<int>").toArrow().to_pandas()
    rows = rows.sort_values(["doc_id", "y"], kind="stable")
    y = rows["y"].to_numpy(np.float64)
    if not len(rows):
        return NoisyOr(0.0)
    counts = rows["n"].to_numpy()
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])
    words = np.concatenate(rows["words"].to_list()).astype(np.int64).view(U64)
    sentence = np.concatenate([s + b for s, b in zip(rows["sentence"], base, strict=True)]).astype(np.int64)
    return NoisyOr.trained(words, sentence, np.repeat(np.arange(len(y)), counts), y, np.array([stands_for[int(v)] for v in y]))


def scored(docs: DataFrame, model: NoisyOr, located: float = 0.5) -> DataFrame:
    """doc_id, score, n_sentences and the sentences with a score of `located` or more, as places in the text's characters."""
    return mapped(docs.select(F.col("doc_id").cast("long"), text_column().alias("text")), lambda b: _scored(b, model, located), SCORED)
