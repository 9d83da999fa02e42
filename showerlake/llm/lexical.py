"""Ranked lexical search by pipelined term partitioning.

The terms of all items are dealt to owners in the order of falling weight, so that each owner has
about the same number of postings. Documents are indexed once, in blocks: a block holds the
postings of the items' terms, columnar. Then item bundles (up to ITEMS_AT_ONCE items, one bundle
for each block) pass through the owners one after another: at each stage a bundle meets the
owner's postings of its block by cogroup, adds their integer contributions to its sparse document
accumulators and is sent on. An accumulator is left out of what is sent on only if its score and all that later owners
can still add stay below the k-th largest score so far in its block, so nothing that
could rank is lost. The last owner hands on each block's best k, and a window ranks them.

Weights and scores are those of the query's contract (see `contribution` and `weights`). Terms are equal if their 64-bit hashes are.

Null and empty texts have no terms and count for nothing. Items without terms, and items that no document
matches, return no rows. Repeated documents are ranked each; a null doc_id goes last among equal scores.
Rows of equal item_id are ranked each on their own. Empty tables return no rows. Other columns are not looked at.
A text of any length is read in one piece by one task; what is kept of it is one entry for each of the items' terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, mapped, signed, text_chunks, text_column, word_hashes, words_of, written

OWNERS = 4
ITEMS_AT_ONCE = 256
#: A block ends at so many documents or postings, so that a bundle's scores take 16 MB at most.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 2 << 20
#: Terms of items that are sent to all tasks at once; with more of them, the items are searched in slices.
MOST_TERMS = 1 << 20
#: No document adds so much for a weight of one: (10^9 tf) div (1000 tf + 12 m) is less.
CEILING = 1_000_000

#: Bytes that part terms: all ASCII but digits and letters.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

BLOCK = "block long, doc_id array<long>, n array<long>, term array<int>, len array<int>, pos array<int>, tf array<int>"
POSTINGS = "block long, doc_id array<long>, docs int, term array<int>, len array<int>, pos array<int>, part array<int>"
BUNDLE = "block long, grp int, item array<int>, pos array<int>, score array<long>"
BEST = "item int, item_id long, doc_id long, score long"


def contribution(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a weight of one earns in a document of n terms that holds the term tf times; integers throughout."""
    m = 75 + (25 * n * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def term_counts(texts: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of whole texts: (first row, terms of each text, text, term, times) with a row for each text and distinct term.

    A term is its hash, or its place in `known` (sorted hashes), and then other terms only count into the texts' sizes."""
    for at, end, data, offsets in text_chunks(texts, CHUNK_BYTES):
        data = _LOWER[data]
        starts, ends, text = words_of(data, offsets, _BETWEEN)
        n = np.bincount(text, minlength=end - at)
        h = word_hashes(data, starts, ends)
        if known is None:
            names, term = np.unique(h, return_inverse=True)
        else:
            names = np.arange(len(known))
            term = np.searchsorted(known, h)
            hit = known[np.minimum(term, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
            text, term = text[hit], term[hit]
        pairs, times = np.unique(text * max(1, len(names)) + term, return_counts=True)
        yield at, n, pairs // max(1, len(names)), names[pairs % max(1, len(names))], times


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, n, text, term, times in term_counts(b.column(1)):
            ends = np.searchsorted(text, np.arange(len(n) + 1))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), _lists(signed(term), ends, pa.int64()), _lists(times, ends, pa.int64())], ["item_id", "term", "times"])


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _blocks(known: np.ndarray, block_docs: int) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, docs, postings = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def block() -> pa.RecordBatch:
            pos, term, tf = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
            order = np.argsort(term, kind="stable")
            terms, lens = np.unique(term, return_counts=True)
            one = lambda x, kind: _lists(x, np.array([0, len(x)]), kind)
            names = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), one(np.concatenate([p[0] for p in parts]), pa.int64())]
                + [one(x, pa.int32()) for x in (terms, lens, pos[order], tf[order])], ["block", "doc_id", "n", "term", "len", "pos", "tf"])

        for b in batches:
            for at, n, text, term, times in term_counts(b.column(1), known):
                for first in range(0, len(n), block_docs):
                    here = slice(*np.searchsorted(text, [first, min(len(n), first + block_docs)]))
                    size = len(n[first : first + block_docs])
                    if parts and (docs + size > block_docs or postings + here.stop - here.start > BLOCK_POSTINGS):
                        yield block()
                        number, ids, parts, docs, postings = number + 1, [], [], 0, 0
                    ids.append(b.column(0).slice(at + first, size))
                    parts.append((n[first : first + size], text[here] - first + docs, term[here], times[here]))
                    docs, postings = docs + size, postings + here.stop - here.start
        if parts:
            yield block()

    return step


def _owned(mine: np.ndarray, n_docs: int, n_terms: int, last: bool) -> Callable:
    """The postings of an owner's terms, with what each adds to a weight of one."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                n, term, lens, pos, tf = (b.column(b.schema.get_field_index(c))[i].values.to_numpy(zero_copy_only=False) for c in ("n", "term", "len", "pos", "tf"))
                here = mine[term]
                rows = np.repeat(here, lens)
                part = contribution(tf[rows].astype(np.int64), n[pos[rows]], n_docs, n_terms)
                one = lambda x: _lists(x, np.array([0, len(x)]), pa.int32())
                ids = b.column(1)[i].values if last else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(n)], pa.int32()), one(term[here]), one(lens[here]), one(pos[rows]), one(part)], ["block", "doc_id", "docs", "term", "len", "pos", "part"])

    return step


class Group:
    """The items of a bundle: their (item, term, weight) entries by term, and what the owners after each stage can still add."""

    def __init__(self, items: list[tuple[int, int | None, np.ndarray, np.ndarray]], weight: np.ndarray, owner: np.ndarray):
        self.places, self.ids = np.array([x[0] for x in items], np.int32), [x[1] for x in items]
        item = np.repeat(np.arange(len(items)), [len(x[2]) for x in items])
        term = np.concatenate([x[2] for x in items])
        worth = weight[term] * np.concatenate([x[3] for x in items])
        order = np.argsort(term, kind="stable")
        self.item, self.term, self.worth = item[order], term[order], worth[order]
        self.rest = np.array([np.bincount(item, worth * (owner[term] > s), len(items)) for s in range(OWNERS)]).astype(np.int64) * CEILING


def _advance(groups: list[Group], stage: int, k: int) -> Callable:
    """One stage: a bundle and the owner's postings of its block give the bundle that goes on, or at the end its best k of each item."""
    last = stage == OWNERS - 1

    def step(key: tuple, bundle: pa.Table, postings: pa.Table) -> pa.Table:
        group = groups[key[1].as_py()]
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        docs = postings.column("docs")[0].as_py()
        score = np.zeros((len(group.ids), docs), np.int64)
        score[flat(bundle, "item"), flat(bundle, "pos")] = flat(bundle, "score")
        pos, part, at = flat(postings, "pos"), flat(postings, "part").astype(np.int64), 0
        for term, n in zip(flat(postings, "term"), flat(postings, "len"), strict=True):
            entries = slice(*np.searchsorted(group.term, [term, term + 1]))
            score[group.item[entries, None], pos[None, at : at + n]] += group.worth[entries, None] * part[None, at : at + n]
            at += n
        kth = np.partition(score, docs - k, axis=1)[:, docs - k] if docs > k else np.zeros(len(score), np.int64)
        item, place = np.nonzero((score > 0) & (score + group.rest[stage][:, None] >= kth[:, None]))
        found = score[item, place]
        if not last:
            return pa.table({"block": [key[0].as_py()], "grp": pa.array([key[1].as_py()], pa.int32())} | {c: _lists(v, np.array([0, len(v)]), t) for c, v, t in (("item", item, pa.int32()), ("pos", place, pa.int32()), ("score", found, pa.int64()))})
        ids = postings.column("doc_id").combine_chunks().flatten().take(pa.array(place))
        order = np.lexsort((ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), -found, item))
        item = item[order]
        order = order[np.arange(len(item)) - np.searchsorted(item, item) < k]
        item = np.sort(item)[np.arange(len(item)) - np.searchsorted(item, item) < k]
        return pa.table({"item": pa.array(group.places[item]), "item_id": pa.array([group.ids[i] for i in item], pa.int64()), "doc_id": ids.take(pa.array(order)), "score": found[order]})

    return step


def _searched(docs: DataFrame, items: list, k: int, block_docs: int) -> DataFrame:
    """The best k documents of each block for each of the items, which the driver knows: (place, id, hashes, times)."""
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in items)]))
    blocks = written(mapped(docs, _blocks(known, block_docs), BLOCK), "lexical-blocks")
    n_docs, n_terms = blocks.select(F.sum(F.size(F.filter("n", lambda n: n > 0))), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    counts = blocks.select(F.explode(F.arrays_zip("term", "len")).alias("t")).groupBy("t.term").agg(F.sum("t.len").alias("df")).toPandas()
    df = np.zeros(len(known), np.int64)
    df[counts["term"].to_numpy(int)] = counts["df"].to_numpy(np.int64)
    weight = weights(df, n_docs or 0)
    order = np.lexsort((np.arange(len(df)), -weight))
    owner = np.empty(len(df), np.int64)
    before = np.cumsum(df[order]) - df[order]
    owner[order] = before * OWNERS // max(1, df.sum())
    placed = [(i, name, np.searchsorted(known, h), times) for i, name, h, times in items]
    groups = [Group(placed[i : i + ITEMS_AT_ONCE], weight, owner) for i in range(0, len(placed), ITEMS_AT_ONCE)]
    all_groups = F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))).alias("grp")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    bundles = blocks.select("block", all_groups, empty("int").alias("item"), empty("int").alias("pos"), empty("long").alias("score"))
    for stage in range(OWNERS):
        last = stage == OWNERS - 1
        postings = mapped(blocks, _owned(owner == stage, n_docs or 0, n_terms or 0, last), POSTINGS).select("*", all_groups)
        bundles = bundles.groupBy("block", "grp").cogroup(postings.groupBy("block", "grp")).applyInArrow(_advance(groups, stage, k), BEST if last else BUNDLE)
    return bundles


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, block_docs: int = BLOCK_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """The k documents (doc_id, text) of highest score of each item (item_id, text): item_id, rank, doc_id, score."""
    docs = docs.select(F.col("doc_id").cast("long"), text_column().alias("text"))
    terms = written(mapped(items.select(F.col("item_id").cast("long"), text_column().alias("text")), _item_terms, "item_id long, term array<long>, times array<long>"), "lexical-items")
    slices = max(1, -(-(terms.agg(F.sum(F.size("term"))).first()[0] or 0) // most_terms))
    found, places = None, 0
    for i in range(slices):
        rows = terms.filter(F.size("term") > 0).filter(F.pmod(F.xxhash64("item_id", "term"), F.lit(slices)) == i).orderBy("item_id", "term").collect()
        if rows:
            part = _searched(docs, [(places + j, r["item_id"], np.array(r["term"], np.int64).view(np.uint64), np.array(r["times"], np.int64)) for j, r in enumerate(rows)], k, block_docs)
            found, places = part if found is None else found.unionByName(part), places + len(rows)
    if found is None:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
