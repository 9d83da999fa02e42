"""Boosted regression trees, many models in step.

All models (each output, each fold held out) grow their trees together over one table of binned features: a level of all
their trees is one pass over the rows, which gives the sums of residuals by (model, node, feature, bin). Those sums, whose
number depends on the models alone, are all that the driver sees. So 15 models take as many jobs as one.

Squared error, depth 3 and shrinkage by default; the first prediction is the training rows' mean. Edges are exact
quantiles of each feature. Of equal gains the first feature and the first edge win. Null features count as 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..sources.shared import written

BINS = 64
#: Trees after which the rows are kept with their scores, so that a pass never evaluates more than so many trees.
KEPT_TREES = 5
#: More partial sums than this are added up by tasks before they reach the driver.
MOST_PARTS = 64


@dataclass
class Boosted:
    names: tuple[str, ...]
    outputs: tuple[str, ...]
    folds: tuple[int, ...]
    depth: int
    edges: list[np.ndarray]
    base: np.ndarray  #: first prediction of each model
    split_feature: list[np.ndarray] = field(default_factory=list)  #: for each tree: model x inner node; -1 where a node isn't split
    split_bin: list[np.ndarray] = field(default_factory=list)  #: codes up to this one go left
    values: list[np.ndarray] = field(default_factory=list)  #: for each tree: model x leaf
    gain: np.ndarray | None = None  #: model x feature

    @property
    def kinds(self) -> list[tuple[str, int]]:
        return [(o, k) for o in self.outputs for k in self.folds]

    def importance(self) -> dict[tuple[str, int], list[tuple[str, float]]]:
        """Each feature's share of the squared error that splits have taken away."""
        total = self.gain.sum(1, keepdims=True)
        share = np.divide(self.gain, total, out=np.zeros_like(self.gain), where=total > 0)
        return {kind: list(zip(self.names, share[m].tolist(), strict=True)) for m, kind in enumerate(self.kinds)}

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bin of each value, features x rows."""
        kind = code_type(max((len(e) for e in self.edges), default=0))
        return np.stack([np.searchsorted(e, x[:, j], "right").astype(kind) for j, e in enumerate(self.edges)])

    def added(self, codes: np.ndarray, score: np.ndarray, first: int, models: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Scores (models x rows) with the trees from `first` on."""
        score, trees = score.copy(), list(zip(self.split_feature[first:], self.split_bin[first:], self.values[first:], strict=True))
        together = max(1, 8 // max(1, self.depth))  # their leaves are one small place, and are looked up at once
        for some in (trees[i : i + together] for i in range(0, len(trees), together)):
            at, table = 0, np.zeros((score.shape[0], 1))
            for feature, split, values in some:
                at = (at << self.depth) + nodes(codes, feature[models], split[models], self.depth)
                table = (table[:, :, None] + values[models][:, None, :]).reshape(len(table), -1)
            for one, places, found in zip(score, at, table, strict=True):
                one += found.take(places.astype(np.intp))
        return score


def code_type(most: int) -> np.dtype:
    """The least type that holds the codes 0 to `most`; a value beyond them stands for a node that isn't split."""
    return np.dtype(np.uint8 if most < 255 else np.uint16 if most < 65535 else np.int64)


def nodes(codes: np.ndarray, feature: np.ndarray, split: np.ndarray, levels: int) -> np.ndarray:
    """The node of the given level that each row falls into, models x rows."""
    limit = np.where(feature >= 0, split, np.iinfo(codes.dtype).max).astype(codes.dtype)[:, :, None]
    used, at = np.maximum(feature, 0), np.zeros((len(feature), codes.shape[1]), np.uint8 if levels < 8 else np.int64)
    for level in range(levels):
        right = codes[used[:, 0]] > limit[:, 0] if level == 0 else np.zeros(at.shape, bool)
        for i in range(2**level if level else 0):
            inner = 2**level - 1 + i
            right |= (at == i) & (codes[used[:, inner]] > limit[:, inner])
        at = 2 * at + right
    return at


def _two(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


#: Rows of a block. A block is one row of the table of binned features: rows of one fold, their codes, and what each model that
#: learns from them has left to explain, as arrays with the rows side by side, so that a pass neither takes rows apart nor puts
#: them together. A fold that no model leaves out is -1.
BLOCK = 8192
BLOCKS = "fold int, codes binary, rest binary"
#: Bins of a round in which the cuts are sought: many ranks of few columns need no fine ones.
CUT_BINS = 4096
#: Features of up to so many bins are summed two at a time, by both their bins, and taken apart once a task: half as many sums.
PAIRED = 128
#: Bytes that a task gets at once: larger batches cost more than they save.
BATCH_BYTES = 1 << 20


def _learning(model: Boosted, fold: int) -> np.ndarray:
    """The models that learn from rows of the fold."""
    return np.array([m for m, (_, k) in enumerate(model.kinds) if k != fold], int)


def _block(fold: int, codes: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([fold], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (codes, rest)]]
    return pa.RecordBatch.from_arrays(columns, ["fold", "codes", "rest"])


def _batch(row: Row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row["fold"]], pa.int32()), *[pa.array([bytes(row[c])], pa.binary()) for c in ("codes", "rest")]], ["fold", "codes", "rest"])


def _since(model: Boosted, first: int) -> Boosted:
    """The model with its trees from `first` on alone, for tasks."""
    return replace(model, split_feature=model.split_feature[first:], split_bin=model.split_bin[first:], values=model.values[first:], gain=None)


def _blocks(model: Boosted, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block its fold, codes (features x rows), the models that learn from it, and their residuals (models x rows)."""
    kind = code_type(max((len(e) for e in model.edges), default=0))
    learning = {k: _learning(model, k) for k in {-1, *model.folds}}
    for b in batches:
        for fold, codes, rest in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            codes = np.frombuffer(codes.as_buffer(), kind).reshape(len(model.names), -1)
            yield fold, codes, learning[fold], np.frombuffer(rest.as_buffer(), float).reshape(-1, codes.shape[1])


def _coded(model: Boosted):
    of = np.array([model.outputs.index(o) for o, _ in model.kinds])

    def block(fold: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        codes, y = (np.concatenate(x, 1) for x in zip(*held, strict=True))
        models = _learning(model, fold)
        return _block(fold, codes, y[of[models]] - model.base[models, None])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            if not len(b):
                continue
            fold, codes, y = b.column(0).to_numpy(), model.codes(_two(b.column(1))), _two(b.column(2)).T
            fold = np.where(np.isin(fold, model.folds), fold, -1)
            for k in np.unique(fold).tolist():
                mine = np.flatnonzero(fold == k)
                held.setdefault(k, []).append((codes[:, mine], y[:, mine]))
                if sum(c.shape[1] for c, _ in held[k]) >= BLOCK:
                    yield block(k, held.pop(k))
        for k, rows in held.items():
            yield block(k, rows)

    return step


def _rescored(model: Boosted, first: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, codes, models, rest in _blocks(model, batches):
            yield _block(fold, codes, -model.added(codes, -rest, first, models))

    return step


def _sums(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _level(model: Boosted, first: int, feature: np.ndarray, split: np.ndarray, level: int, size: int, lesser: np.ndarray | None, counted: bool):
    """Residual sums, and counts if `counted`, by (model, node, feature, bin), one row for each task.

    Below the root a pass looks at one child of each node alone, the one with fewer rows: `lesser` says for each model and node
    whether that is the right one. Its sibling is the rest of the node."""
    together = 2 if size <= PAIRED else 1
    groups, wide = -(-len(model.names) // together), size**together
    above = 2 ** max(0, level - 1)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Arrays of one model and block are small, and so cost no new pages of memory.
        sums = np.zeros((1 + counted, len(model.base), groups, above * wide))
        for _, codes, models, rest in _blocks(model, batches):
            if first < len(model.values):
                rest = -model.added(codes, -rest, first, models)
            places = _places(codes, size, together)
            at = nodes(codes, feature[models], split[models], level) if level else None
            for i, m in enumerate(models):
                mine = rest[i]
                if level:
                    # One child of each node: 2 * node + whether it is the right one.
                    chosen = np.zeros(2 * above, bool)
                    chosen[2 * np.arange(above) + lesser[m]] = True
                    rows = np.flatnonzero(chosen.take(at[i]))
                    mine = mine.take(rows)
                    start = (at[i].take(rows) >> 1) * np.int64(wide) if level > 1 else None
                for g, keys in enumerate(places):
                    if level:
                        keys = keys.take(rows)
                        if level > 1:
                            keys += start
                    sums[0, m, g] += np.bincount(keys, mine, above * wide)
                    if counted:
                        sums[1, m, g] += np.bincount(keys, minlength=above * wide)
        yield _sums(_apart(sums.reshape(1 + counted, len(model.base), groups, above, wide), len(model.names), size, together))

    return step


def _places(codes: np.ndarray, size: int, together: int) -> np.ndarray:
    """One number for the codes of each group of neighbouring features, groups x rows."""
    if together == 1:
        return codes.astype(np.intp)
    places = codes[::2].astype(np.intp) * size
    places[: len(codes) // 2] += codes[1::2]
    return places


def _apart(sums: np.ndarray, features: int, size: int, together: int) -> np.ndarray:
    """Sums by (..., node, feature, bin) from those by (..., group, node, place)."""
    sums = np.moveaxis(sums, -3, -2)
    if together == 2:
        both = sums.reshape(*sums.shape[:-1], size, size)
        sums = np.stack([both.sum(-1), both.sum(-2)], -2).reshape(*sums.shape[:-2], -1, size)
    return np.ascontiguousarray(sums[..., :features, :])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column(0):
            here = np.frombuffer(x.as_buffer())
            total = here if total is None else total + here
    if total is not None:
        yield _sums(total)


def _gathered(rows: RDD, step) -> np.ndarray:
    parts = rows.mapPartitions(step)
    if (n := rows.getNumPartitions()) > MOST_PARTS:
        parts = parts.repartition(max(1, int(n**0.5))).mapPartitions(_merged)
    return np.sum([np.frombuffer(x.as_buffer()) for b in parts.collect() for x in b.column(0)], 0)


def best_splits(count: np.ndarray, total: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For counts and sums by (..., feature, bin): the feature (-1: none helps), the bin and the gain of the best cut of each node."""
    left_n, left = count.cumsum(-1)[..., :-1], total.cumsum(-1)[..., :-1]
    n, s = count.sum(-1, keepdims=True), total.sum(-1, keepdims=True)
    right_n, right = n - left_n, s - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left**2 / left_n + right**2 / right_n - s**2 / n
    gain = np.where((left_n >= least) & (right_n >= least), gain, -np.inf)
    flat = gain.reshape(*gain.shape[:-2], -1)
    at = flat.argmax(-1)
    best = np.take_along_axis(flat, at[..., None], -1)[..., 0]
    helps = best > 1e-12 * np.maximum(1e-300, np.abs(s[..., 0, 0]))
    return np.where(helps, at // gain.shape[-1], -1), at % gain.shape[-1], np.where(helps, best, 0.0)


def _lesser(count: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Whether the right child of each node has no more rows than the left one; the right one of a node that isn't split has none."""
    here = np.take_along_axis(count, np.maximum(feature, 0)[..., None, None], -2)[..., 0, :]
    left = np.where(np.arange(count.shape[-1]) <= split[..., None], here, 0.0).sum(-1)
    return (feature < 0) | (2 * left >= here.sum(-1))


def _with_siblings(above: np.ndarray, found: np.ndarray, lesser: np.ndarray) -> np.ndarray:
    """Counts and sums of all nodes of a level, from those of the level above and of one child of each node there."""
    rest = above - found
    rest[1] = np.where(rest[0] > 0, rest[1], 0.0)  # no rows: exactly nothing, so that equal cuts stay equal
    right = lesser[..., None, None]
    both = np.stack([np.where(right, rest, found), np.where(right, found, rest)], 3)
    return both.reshape(2, len(lesser), -1, *above.shape[-2:])


@contextmanager
def _small_batches(spark: SparkSession):
    """Batches of at most BATCH_BYTES for Python tasks; the session's own bound is never raised, and comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", before.strip().lower()).groups()
    spark.conf.set(key, str(min(BATCH_BYTES, int(number) << 10 * " kmgtp".index(unit or " "))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fit(df: DataFrame, fold: Column, names: tuple[str, ...], outputs: tuple[str, ...], folds: tuple[int, ...], trees: int = 100, rate: float = 0.1, depth: int = 3, bins: int = BINS) -> Boosted:
    """One model for each output and each of `folds`, on the rows of the other folds whose outputs are known."""
    df = df.dropna(subset=list(outputs)).fillna(0.0, list(names)).withColumn("_fold", F.coalesce(fold.cast("int"), F.lit(-1)))
    probs = [i / bins for i in range(1, bins)]
    cuts = quantiles(df, [], {n: (F.col(n), probs) for n in names}, bins=CUT_BINS).first()
    edges = [np.unique(np.array(cuts[n] if cuts and cuts[n] else [], float)) for n in names]
    model = Boosted(tuple(names), tuple(outputs), tuple(folds), depth, edges, np.zeros(len(outputs) * len(folds)))
    means = df.agg(*[F.avg(F.when(F.col("_fold") != k, F.col(o))) for o in outputs for k in folds]).first()
    model.base = np.array([m or 0.0 for m in means])
    model.gain = np.zeros((len(model.base), len(names)))
    with _small_batches(df.sparkSession):
        _grow(model, df, names, outputs, trees, rate, bins)
    return model


def _grow(model: Boosted, df: DataFrame, names: tuple[str, ...], outputs: tuple[str, ...], trees: int, rate: float, bins: int) -> None:
    doubles = lambda cs: F.array(*[F.col(c).cast("double") for c in cs])
    depth = model.depth
    coded = written(df.select(F.col("_fold").alias("fold"), doubles(names).alias("x"), doubles(outputs).alias("y")).mapInArrow(_coded(model), BLOCKS), "boosting")
    # Kept as Python's own bytes: a pass then gets them as they are, not by way of rows and columns.
    kept = lambda blocks: blocks.persist(StorageLevel.MEMORY_AND_DISK)
    rows = kept(coded.rdd.map(_batch))
    first, size, root, before = 0, bins + 1, None, None
    for tree in range(trees):
        models = len(model.base)
        feature, split = np.full((models, 2**depth - 1), -1), np.zeros((models, 2**depth - 1), np.int64)
        lesser = None
        for level in range(depth):
            # At the root, counts are those of the first tree.
            counted = level > 0 or root is None
            found = _gathered(rows, _level(_since(model, first), 0, feature, split, level, size, lesser, counted)).reshape(1 + counted, models, -1, len(names), size)
            if before is not None:
                before = before.unpersist() and None
            if level == 0:
                root = found[1] if counted else root
                sums = np.stack([root, found[0]])
            else:
                sums = _with_siblings(sums, found[::-1], lesser)
            f, b, gain = best_splits(*sums)
            inner = slice(2**level - 1, 2 ** (level + 1) - 1)
            feature[:, inner], split[:, inner] = f, b
            lesser = _lesser(sums[0], f, b)
            for m in range(models):
                np.add.at(model.gain[m], f[m][f[m] >= 0], gain[m][f[m] >= 0])
        pick = np.maximum(f, 0)[..., None, None]
        count, total = (np.take_along_axis(x, pick, 2)[:, :, 0, :] for x in sums)
        left = (np.arange(size)[None, None, :] <= np.where(f >= 0, b, size)[..., None]).astype(float)
        n = np.stack([(count * left).sum(-1), (count * (1 - left)).sum(-1)], -1)
        s = np.stack([(total * left).sum(-1), (total * (1 - left)).sum(-1)], -1)
        value = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
        model.split_feature.append(feature)
        model.split_bin.append(split)
        model.values.append(rate * value.reshape(models, 2**depth))
        if (tree + 1) % KEPT_TREES == 0 and tree + 1 < trees:
            # A pass over the new scores comes before the old ones go.
            before, rows = rows, kept(rows.mapPartitions(_rescored(_since(model, first), 0)))
            first = tree + 1
    rows.unpersist()


def predicted(model: Boosted, df: DataFrame, fold: Column) -> DataFrame:
    """The rows of the model's folds, with `fold` and pred_<output> by the models that have not seen them."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = df.withColumn("fold", fold.cast("int")).filter(F.col("fold").isin(*model.folds))
    x = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in model.names])
    schema = StructType([*rows.schema.fields, *[StructField(f"pred_{o}", DoubleType()) for o in model.outputs]])
    place = rows.columns.index("fold")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            codes, fold, pred = model.codes(_two(b.column(b.num_columns - 1))), b.column(place).to_numpy(), np.zeros((len(model.outputs), len(b)))
            for i, k in enumerate(model.folds):
                mine, models = np.flatnonzero(fold == k), np.arange(i, len(model.base), len(model.folds))
                pred[:, mine] = model.added(codes[:, mine], np.tile(model.base[models, None], (1, len(mine))), 0, models)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x) for x in pred]], names=[f.name for f in schema.fields])

    return rows.withColumn("_x", x).mapInArrow(step, schema)
