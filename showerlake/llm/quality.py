"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one feature at a time are boosted in turns (cyclic), so each feature ends
as a lookup table over its bins; then the pairs that explain most of what is left get tables over
two features. A score is a vectorised sum of looked-up values.

The model is fitted on at most about `sample_rows` labelled documents, chosen by a hash of
doc_id; everything else covers all rows. Inputs of a score are counts of the text alone.
Null and empty texts get the score of their (zero) counts. Repeated rows get equal
scores. Other columns pass through, whatever their names. A text beyond one chunk is scored like any other; the arrays
of its words and bytes stand in one task. Without labels of both kinds the score is the share of label 1 (one half if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LITTLE, SPACE, U64, filled, fresh, gram_hashes, mapped, powers, text_chunks, text_column, word_hashes, words_of

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, N_PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 60, 30, 0.15, 1.0

# Classes of bytes. 0: others, that is letters and the bytes of other scripts.
_KINDS = {"space": SPACE, "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".!?", "mark": ",;:'\"()-", "symbol": "#*$%&|<>@{}[]=_~^+\\/"}
_KIND = np.zeros(256, np.int64)
for _i, _chars in enumerate(_KINDS.values(), 1):
    _KIND[list(_chars.encode())] = _i
_N = len(_KINDS) + 1
FEATURES = ["log_words", "word_length", "longest_word", *_KINDS, "bang", "repeats_before", "distinct_words", "distinct_grams", "distinct_lines", "words_per_line"]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has (40 bits of each are looked at)."""
    key = np.sort((doc.astype(U64) << U64(40)) | (h >> U64(24)))
    new = np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]])
    return np.bincount((key[new] >> U64(40)).astype(np.int64), minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), lengths)
    kinds = np.bincount(owner * _N + _KIND[data], minlength=n * _N).reshape(n, _N)
    bangs = np.bincount(owner[data == ord("!")], minlength=n)
    starts, ends, doc = words_of(data, offsets)
    words = word_hashes(data, starts, ends)
    n_words = np.bincount(doc, minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, ends - starts)
    same = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    grams = gram_hashes(words, 3)
    inside = doc[: len(grams)] == doc[2 : 2 + len(grams)] if len(grams) else np.zeros(0, bool)
    cut = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1][lengths > 0])
    line_owner = np.searchsorted(offsets, cut, "right") - 1
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[: len(data)], out=sums[1:])
    line_end = np.minimum(np.append(cut[1:], len(data)), offsets[line_owner + 1]) if len(cut) else cut
    full = cut < len(data)
    cut, line_owner, line_end = cut[full], line_owner[full], line_end[full]
    stop = line_end - (data[line_end - 1] == 10)  # a last line without a line end may equal an earlier one
    lines = (sums[stop] - sums[cut]) * powers(len(data), True)[cut] if len(cut) else np.zeros(0, U64)
    n_lines = np.bincount(line_owner, minlength=n)
    per = lambda x, by: x / np.maximum(by, 1)
    return np.column_stack([
        np.log1p(n_words), per(lengths - kinds[:, 1], n_words), longest, per(kinds[:, 1:], lengths[:, None]), per(bangs, lengths),
        per(np.bincount(doc[1:][same], minlength=n), n_words), per(_distinct(doc, words, n), n_words),
        per(_distinct(doc[: len(grams)][inside], grams[inside], n), np.maximum(n_words - 2, 0)), per(_distinct(line_owner, lines * U64(0x9E3779B97F4A7C15), n), n_lines), per(n_words, n_lines),
    ])


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) over the bins of one feature."""
    cg, ch = np.cumsum(g, -1), np.cumsum(h, -1)
    tg, th = cg[-1], ch[-1]
    gain = cg[:-1] ** 2 / (ch[:-1] + SMOOTH) + (tg - cg[:-1]) ** 2 / (th - ch[:-1] + SMOOTH) - tg**2 / (th + SMOOTH)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and gain[k] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of at most 2**depth leaves over the bins, as the value it adds to each bin."""
    _, k = _best_split(g, h) if depth else (0, 0)
    if not k:
        return np.full(len(g), -RATE * g.sum() / (h.sum() + SMOOTH))
    return np.concatenate([shallow_tree(g[:k], h[:k], depth - 1), shallow_tree(g[k:], h[k:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A split on the first feature, then one on the second on either side."""
    best, table = -1.0, np.zeros_like(g)
    for k in range(1, len(g)):
        halves = [(g[:k].sum(0), h[:k].sum(0)), (g[k:].sum(0), h[k:].sum(0))]
        splits = [_best_split(*x) for x in halves]
        gain = sum(s[0] + a.sum() ** 2 / (b.sum() + SMOOTH) for s, (a, b) in zip(splits, halves, strict=True))
        if gain > best:
            best = gain
            table = np.concatenate([np.tile(shallow_tree(*halves[0], 1), (k, 1)), np.tile(shallow_tree(*halves[1], 1), (len(g) - k, 1))])
    return table


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


class AdditiveModel:
    """intercept + a table for each feature + a table for each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = float(np.mean(y)) if len(y) else 0.5
        self.constant = None if len(y) and 0 < share < 1 else share
        if self.constant is not None:
            return
        self.edges = [_edges(c, BINS) for c in x.T]
        self.coarse = [_edges(c, PAIR_BINS) for c in x.T]
        self.intercept = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        codes, coarse = self._codes(x, self.edges), self._codes(x, self.coarse)
        f = np.full(len(y), self.intercept)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return p - y, p * (1 - p)

        for _ in range(ROUNDS):
            for j, c in enumerate(codes):
                g, h = (np.bincount(c, v, len(self.tables[j])) for v in slopes())
                step = shallow_tree(g, h)
                self.tables[j] += step
                f += step[c]

        def grid(i: int, j: int) -> list[np.ndarray]:
            shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            cell = coarse[i] * shape[1] + coarse[j]
            return [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in slopes()]

        def worth(pair: tuple[int, int]) -> float:
            g, h = grid(*pair)
            return float((g**2 / (h + SMOOTH)).sum())

        self.pairs = sorted(combinations(range(x.shape[1]), 2), key=worth, reverse=True)[:N_PAIRS]
        self.pair_tables = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, (i, j) in enumerate(self.pairs):
                step = pair_tree(*grid(i, j))
                self.pair_tables[k] += step
                f += step[coarse[i], coarse[j]]

    @staticmethod
    def _codes(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        codes, coarse = self._codes(x, self.edges), self._codes(x, self.coarse)
        f = self.intercept + sum(t[c] for t, c in zip(self.tables, codes, strict=True))
        f += sum(t[coarse[i], coarse[j]] for t, (i, j) in zip(self.pair_tables, self.pairs, strict=True))
        return 1 / (1 + np.exp(-f))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, by_class: bool = False) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, y) of about `rows` usable labelled documents at most (with by_class: of each label), chosen by a
    hash of doc_id; and how many labelled rows each chosen one stands for, by label."""
    ids = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable).select("doc_id", F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = {y: min(1.0, rows / max(1, n if by_class else total)) for y, n in counts.items()}
    cut = F.lit(0.0)
    for y, s in share.items():
        cut = F.when(F.col("y") == y, F.lit(s)).otherwise(cut)
    chosen = ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 30)) < cut * (1 << 30))
    # The chosen ids are bounded by `rows`, so they can be broadcast.
    return docs.select("doc_id", text_column().alias("text")).join(F.broadcast(chosen), "doc_id"), {y: 1 / s for y, s in share.items()}


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column(batch.schema.get_field_index("y")).to_numpy()
        for first, end, data, offsets in text_chunks(filled(batch), LITTLE):
            yield pa.RecordBatch.from_pydict({"y": pa.array(y[first:end], pa.int32()), "x": pa.array(list(features(data, offsets)), pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    sample, _ = labelled_sample(docs, labels, label, usable, sample_rows)
    rows = mapped(sample.select("text", "y"), _rows_of, "y int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    order = np.lexsort(x.T)  # the same model however the rows arrive
    return AdditiveModel(x[order], rows["y"].to_numpy(np.float64)[order])


def _scored(batches: Iterator[pa.RecordBatch], model: AdditiveModel, text: str, name: str) -> Iterator[pa.RecordBatch]:
    """The last column is the text that is scored; its score takes its place."""
    for batch in batches:
        scores = [model.score(features(data, offsets)) for _, _, data, offsets in text_chunks(filled(batch, text), LITTLE)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*batch.schema.names[:-1], name])


def with_score(docs: DataFrame, model: AdditiveModel, name: str = "_score") -> DataFrame:
    """The rows of `docs` with their score as the last column, `name`, which `docs` must not have. No shuffle."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    if fresh(docs, name) != name:
        raise ValueError(f"the rows have a column {name}")
    text = fresh(docs, "_text")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return mapped(docs.withColumn(text, text_column()), lambda b: _scored(b, model, text, name), schema)
