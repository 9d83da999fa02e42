"""Substring dedup by fixed-block anchors, over word windows.

A window of 13 words holds a whole block of 7 words wherever the blocks of its document
begin, so: index the neighbouring blocks of every document (places 0, 7, 14, ...), probe the
index with every rolling window of 7 words, and extend the hits to all windows of 13
words around them. The index is a filter of fixed size (see filters.py), so both scans are
map-only. Windows around hits are then compared by their hash, over all documents: the smallest doc_id
that starts each one is found, and runs of such windows are the maximal exact repeats.

A window that several documents of one chunk of text start goes into the comparison once,
for the smallest of them, so a passage of a third of all documents is a few rows a task.
A null doc_id comes after all others. Documents that share a doc_id do not count
against each other. Null and empty texts have no words; texts under 13 words lose none. An
empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import filters
from .common import U64, filled, gram_hashes, mapped, mix, signed, text_chunks, text_column, word_hashes, words_of

WINDOW = 13
BLOCK = 7
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (a null as the largest number), a hash of the text, the text: together they name a row, up to equal rows."""
    text = text_column()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"), *more)


def _grams(data: np.ndarray, offsets: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """Word hashes, hashes of all rolling windows of `block` words that stay in a text, their text and their place in it."""
    starts, ends, doc = words_of(data, offsets)
    words = word_hashes(data, starts, ends)
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    h = gram_hashes(words, block)
    return words, h, doc, place


def _within(doc: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which runs of `length` words from each word stay in its text (n: how many there are)."""
    return doc[:n] == doc[length - 1 : length - 1 + n] if n else np.zeros(0, bool)


def _index(batch: pa.RecordBatch, block: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_chunks(filled(batch)):
        _, h, doc, place = _grams(data, offsets, block)
        yield h[_within(doc, len(h), block) & (place[: len(h)] % block == 0)]


def _probes(batch: pa.RecordBatch, block: int, index: Broadcast) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_chunks(filled(batch)):
        _, h, doc, place = _grams(data, offsets, block)
        h = h[_within(doc, len(h), block) & (place[: len(h)] % block != 0)]
        yield h[filters.test(filters.shared(index), h)]


ROWS = "h long, did long, th long, place int, least long"


def _windows(batches: Iterator[pa.RecordBatch], window: int, block: int, index: Broadcast, twice: Broadcast, probed: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, _, data, offsets in text_chunks(filled(batch)):
            words, h, doc, place = _grams(data, offsets, block)
            whole = gram_hashes(words, window)
            if not len(whole):
                continue
            own = place[: len(h)] % block == 0
            inside = _within(doc, len(h), block)
            hit = np.zeros(len(h), bool)
            hit[inside & ~own] = filters.test(filters.shared(index), h[inside & ~own])
            hit[inside & own] = filters.test(filters.shared(twice), h[inside & own]) | filters.test(filters.shared(probed), h[inside & own])
            near = np.concatenate([[0], np.cumsum(hit)])
            n, span = len(whole), window - block + 1
            at = np.flatnonzero((near[span : span + n] - near[:n] > 0) & _within(doc, n, window))
            if not len(at):
                continue
            w, d = whole[at], doc[at]
            did = dids[first + d]
            order = np.lexsort((did, w))
            heads = np.concatenate([[True], w[order][1:] != w[order][:-1]])
            least = np.empty(len(at), np.int64)
            least[order] = did[order][np.flatnonzero(heads)][np.cumsum(heads) - 1]
            key = np.where(least < did, mix(w + U64(1) + at.astype(U64)), w)  # what is decided here meets no one
            yield pa.RecordBatch.from_pydict({"h": signed(key), "did": did, "th": ths[first + d], "place": place[at].astype(np.int32), "least": least})


def repeated_windows(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, log_bits: int = filters.LOG_BITS) -> DataFrame:
    """did, th and the places (word numbers) of the windows that a document with a smaller doc_id also starts."""
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block at any offset")
    share = lambda bits: filters.share(docs.sparkSession, bits)
    rows = keyed(docs)
    once, twice = filters.fill(rows.select("text"), lambda b: _index(b, block), log_bits)
    index, twice = share(once), share(twice)
    [probed] = filters.fill(rows.select("text"), lambda b: _probes(b, block, index), log_bits, ("once",))
    probed = share(probed)
    found = mapped(rows.select("did", "th", "text"), lambda b: _windows(b, window, block, index, twice, probed), ROWS)
    found = found.withColumn("least", F.min("least").over(Window.partitionBy("h"))).filter("least < did")
    return found.groupBy("did", "th").agg(F.collect_set("place").alias("places"))


DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for did, text, places in zip(batch.column(0).to_pylist(), filled(batch).cast(pa.large_binary()).to_pylist(), batch.column(2), strict=True):
            words = text.split()
            n = len(words)
            if places.is_valid:
                gone = np.zeros(n + 1, np.int32)
                at = places.values.to_numpy()
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
                words = [w for w, g in zip(words, np.cumsum(gone)[:n], strict=True) if not g]
            kept = b" ".join(words)
            out.append((did, n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in zip(range(len(names)), types, strict=False)], names=names)


def without_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, log_bits: int = filters.LOG_BITS, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space, and with_text those."""
    found = repeated_windows(docs, window, block, log_bits)
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    met = rows.join(found, ["did", "th"], "left").select("doc_id", "text", "places")
    return mapped(met, lambda b: _cut(b, window, with_text), DONE + (", kept_text string" if with_text else ""))


