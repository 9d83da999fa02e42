"""N-gram Jaccard join by chosen paths.

A document is the set of its 5-word shingles. Each run sends a set to a bucket for each of its
tokens whose hash of the run falls under 1 / (threshold * size), so two similar sets
meet in a bucket with a chance of two thirds; a bucket that is still large is split again on other
sampled tokens, level by level (one beyond a bound first meets a few pivots, and only sets that none of them
covers are split), and runs repeat until the target recall: a pair at the threshold
that is split over k levels is found by a run with a chance of (2/3)^k, so sets of buckets that are split
twice and more are sent through more runs. Small buckets are compared by brute force, on sketches;
a last bucket beyond a bound is dealt over many tasks in blocks, each of which meets the same few pivots,
and sets that no pivot covers meet block against block; what may be similar is linked, and the sets linked so,
directly or over others, are then compared exactly, all pairs of them, in tiles of bounded size. No
pair of documents is ever a row: a tile gives each of its sets the number of its links.

Equal sets (copies above all) are one set throughout. A text of under five words is one shingle of
all its words; a text without words (null, empty) has no links and is its own class.
Rows that repeat a doc_id are documents of their own. A null doc_id can't name a class. A text of any
length is read in chunks for its sketch, and is held whole only while it is compared, in a tile of a bounded
number of sets. An empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LITTLE, U64, WORD_CLASS, filled, gram_hashes, mapped, mix, settled, signed, text_chunks, text_column, word_hashes, words_of, written
from .components import components
from .substring import keyed

SHINGLE = 5
THRESHOLD = 0.8
#: Runs of all sets, and of sets in buckets that are split twice and more. At the threshold, a pair's recall is
#: 1 - (1 - (2/3)^k)^runs: with 16 runs over 0.9999 to two levels; with 32 over 0.9999 at three levels and 0.9991 at four.
FIRST_RUNS, RUNS = 16, 32  # at most 32
LEVELS = 4
SMALL_BUCKET = 48
#: Sets of one bucket that a task compares; a tile of two blocks has about twice as many.
LARGE_BUCKET = 2_048
#: Sets of a bucket beyond which it meets pivots before it is split.
PIVOTS_FIRST = 2_048
PIVOTS, PIVOT_ROUNDS = 64, 3
SKETCH = 128
#: Estimated similarity from which sets of a small bucket are linked: the threshold less five deviations of the sketch.
MAYBE = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / SKETCH) ** 0.5
#: In a large bucket, a set this close to a pivot needs no comparison of its own: what is similar to it is linked to the pivot too.
COVERED, NEAR_PIVOT = THRESHOLD, 0.45
TILE = 256
#: Shingles of one text that are hashed for all runs at once, so that a text of millions of words takes no more room.
SAMPLED_AT_ONCE = 1 << 15

_RUN_MULTIPLIERS = mix(np.arange(1, RUNS * LEVELS + 1, dtype=U64)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    starts, ends, doc = words_of(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = gram_hashes(words, k)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        else:
            yield gram_hashes(words[a:b], b - a) + U64(b - a) if b > a else np.zeros(0, U64)


BASE = "did long, th long, sh long, n int, sketch binary, t1 array<long>, t2 array<long>, t3 array<long>, t4 array<long>"


def _sampled(s: np.ndarray, multipliers: np.ndarray, most: np.uint64) -> np.ndarray:
    """The tokens of each run, with the number of the run in their last five bits."""
    i, run = np.nonzero(s[:, None] * multipliers[None, :] <= most)
    return (mix(s[i]) & ~U64(31)) | run.astype(U64)


def _described(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("sh", "n", "sketch", "t1", "t2", "t3", "t4")}
        for _, _, data, offsets in text_chunks(filled(batch), LITTLE):
            for s in shingle_sets(data, offsets):
                out["n"].append(len(s))
                out["sh"].append(int(signed(mix(np.array([np.sum(s * U64(0x9E3779B97F4A7C15)) ^ np.bitwise_xor.reduce(s), len(s)], U64)).sum(keepdims=True))[0]) if len(s) else 0)
                out["sketch"].append(np.sort((mix(s + U64(0x5BD1E995)) >> U64(32)).astype(np.uint32))[:SKETCH].tobytes())
                most = U64(min(2**64 - 1, int(2**64 / (threshold * max(1, len(s))))))
                for level in range(LEVELS):
                    multipliers = _RUN_MULTIPLIERS[level * RUNS : (level + 1) * RUNS]
                    out[f"t{level + 1}"].append(signed(np.concatenate([_sampled(s[at : at + SAMPLED_AT_ONCE], multipliers, most) for at in range(0, max(1, len(s)), SAMPLED_AT_ONCE)])))
        lists = {c: pa.array(out[c], pa.list_(pa.int64())) for c in ("t1", "t2", "t3", "t4")}
        yield pa.RecordBatch.from_pydict({"did": batch.column(0), "th": batch.column(1), "sh": pa.array(out["sh"], pa.int64()), "n": pa.array(out["n"], pa.int32()), "sketch": pa.array(out["sketch"], pa.binary()), **lists})


def leaf_buckets(sets: DataFrame, sketches: DataFrame, small: int, large: int, first: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """path, sh, size: the buckets of two sets and more in which splitting ends; sh of the sets in buckets that are
    split twice and more; and links. `sets` has a row for each sh.

    Splitting doesn't tell near copies apart, and a large group of them would go through all levels in every run. So
    a bucket beyond `first` meets pivots before it is split, and only sets that no pivot covers go on."""
    deep, links = None, []
    rows = sets.select("sh", F.explode("t1").alias("path"))
    leaves = None
    for level in range(1, LEVELS + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        sized = written(rows.join(sizes, "path"), f"buckets-{level}").select("path", "sh", "size")
        big = sized.filter(F.col("size") > first)
        if level < LEVELS and not big.isEmpty():
            left, found = met_by_pivots(big, sketches, large, level)
            sized = sized.filter(F.col("size") <= first).unionByName(left)
            links.append(found)
        ended = sized if level == LEVELS else sized.filter(F.col("size") <= small)
        leaves = ended if leaves is None else leaves.unionByName(ended)
        split = sized.filter(F.col("size") > small).select("path", "sh")
        if level == LEVELS or split.isEmpty():
            break
        if level == 2:
            deep = split.select("sh").distinct()
        run = F.col("path").bitwiseAND(31)
        own = F.filter(f"t{level + 1}", lambda t: t.bitwiseAND(31) == run)
        deeper = split.join(sets.select("sh", f"t{level + 1}"), "sh").select("path", "sh", F.explode(own).alias("t"))
        rows = deeper.select("sh", F.xxhash64("path", "t").bitwiseAND(~31).bitwiseOR(run).alias("path"))
    return leaves.select("path", "sh", "size"), deep, links


def all_leaves(base: DataFrame, sketches: DataFrame, small: int, large: int, first: int) -> tuple[DataFrame, list[DataFrame]]:
    """The buckets of the first runs, and those of the other runs for the sets that need them; and links."""
    levels = [f"t{level + 1}" for level in range(LEVELS)]
    some = lambda df, rule: df.groupBy("sh").agg(*[F.first(F.filter(c, rule)).alias(c) for c in levels])
    worded = base.filter("n > 0")
    leaves, deep, links = leaf_buckets(some(worded, lambda t: t.bitwiseAND(31) < FIRST_RUNS), sketches, small, large, first)
    if deep is None:
        return leaves, links
    again = written(some(worded.join(written(deep, "deep"), "sh", "left_semi"), lambda t: t.bitwiseAND(31) >= FIRST_RUNS), "deep-sets")
    more, _, more_links = leaf_buckets(again, sketches, small, large, first)
    return leaves.unionByName(more), links + more_links


def _estimates(pivot: np.ndarray, values: np.ndarray, owner: np.ndarray, ends: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Similarity of the pivot's sketch to each other one, from the hashes that both sketches reach.

    ends: largest hash of each sketch; full: whether the sketch is cut there."""
    top = int(pivot[-1]) if len(pivot) == SKETCH else 1 << 32
    reach = np.minimum(np.where(full, ends, 1 << 32), top)
    within = values <= reach[owner]
    at = np.minimum(np.searchsorted(pivot, values), len(pivot) - 1)
    both = np.bincount(owner[within & (pivot[at] == values)], minlength=len(ends))
    either = np.bincount(owner[within], minlength=len(ends)) + np.searchsorted(pivot, reach, "right") - both
    return both / np.maximum(either, 1)


def bucket_links(sets: list[int], sketches: list[np.ndarray], small: int) -> list[tuple[int, int]]:
    values, owner = np.concatenate(sketches).astype(np.int64), np.repeat(np.arange(len(sets)), [len(s) for s in sketches])
    ends = np.array([s[-1] for s in sketches], np.int64)
    full = np.array([len(s) == SKETCH for s in sketches])
    brute = len(sets) <= small
    active = np.ones(len(sets), bool)
    out = []
    for p in range(len(sets)):
        if not active[p]:
            continue
        active[p] = False
        keep = active[owner]
        est = _estimates(sketches[p].astype(np.int64), values[keep], owner[keep], ends, full)
        est[~active] = 0
        out += [(sets[p], sets[i]) for i in np.flatnonzero(est >= (MAYBE if brute else NEAR_PIVOT))]
        if not brute:
            active &= est < COVERED
    return out


def _star(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components, with one link for each member but one."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in root if find(x) != x]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows sorted by their first `keys` columns, group by group."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held[0][:keys], held
                held = []
            held.append(row)
    if held:
        yield held[0][:keys], held


def _linked(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
    for _, rows in _groups(batches, 1):
        out += _star(bucket_links([r[1] for r in rows], [np.frombuffer(r[2], np.uint32) for r in rows], small))
        if len(out) > 50_000:
            yield batch()
            out = []
    yield batch()


def _met_by_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: path, block, kind (0: pivot, 1: member), sh, sketch; sorted by the first four. Out: links, and path and sh of
    each member that no pivot covers."""
    out: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["path", "sh", "u", "v"])
    for (path, _), rows in _groups(batches, 2):
        pivots, members = [r for r in rows if r[2] == 0], [r for r in rows if r[2] == 1]
        if not members:
            continue
        ids, sketches = np.array([r[3] for r in members], np.int64), [np.frombuffer(r[4], np.uint32) for r in members]
        values, owner = np.concatenate(sketches).astype(np.int64), np.repeat(np.arange(len(ids)), [len(s) for s in sketches])
        ends = np.array([s[-1] for s in sketches], np.int64)
        full = np.array([len(s) == SKETCH for s in sketches])
        active = np.ones(len(ids), bool)
        links = []
        for p in pivots:
            if not active.any():
                break
            keep = active[owner]
            est = _estimates(np.frombuffer(p[4], np.uint32).astype(np.int64), values[keep], owner[keep], ends, full)
            est[~active] = 0
            links += [(p[3], int(i)) for i in ids[est >= NEAR_PIVOT] if i != p[3]]
            active &= (est < COVERED) & (ids != p[3])
        out += [(None, None, u, v) for u, v in _star(links)]
        out += [(path, int(i), None, None) for i in ids[active]]
        if len(out) > 50_000:
            yield batch()
            out = []
    yield batch()


def met_by_pivots(big: DataFrame, sketches: DataFrame, large: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """path, sh, size: the sets of the buckets that no pivot covers, of two and more; and links.

    A bucket is dealt into blocks, and its pivots are sent to each. What is similar to a covered set is linked to the same
    pivot, so covered sets are done."""
    blocks = F.ceil(F.col("size") / large).cast("int")
    block = F.pmod(F.xxhash64("sh"), blocks).cast("int").alias("block")
    pivots = big.groupBy("path", F.pmod(F.xxhash64("sh", F.lit(turn)), F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(F.xxhash64("path", "sh"), "sh")).alias("one"), F.first("size").alias("size"))
    pivots = pivots.select("path", "size", F.col("one.sh").alias("sh")).join(sketches, "sh").select("path", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(0).alias("kind"), "sh", "sketch")
    members = big.join(sketches, "sh").select("path", block, F.lit(1).alias("kind"), "sh", "sketch")
    dealt = pivots.unionByName(members).repartition("path", "block").sortWithinPartitions("path", "block", "kind", "sh")
    met = written(mapped(dealt, _met_by_pivots, "path long, sh long, u long, v long"), "pivots")
    left = met.filter("path is not null").select("path", "sh")
    sizes = left.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
    return left.join(sizes, "path"), met.filter("u is not null").select("u", "v")


def bounded_buckets(leaves: DataFrame, sketches: DataFrame, large: int) -> tuple[DataFrame, list[DataFrame]]:
    """path, sh: buckets of at most `large` sets and tiles of about twice as many, in place of any larger ones; and links.

    A larger bucket meets pivots, round by round, each with new ones. A block meets each other block of what is left after
    some rounds, so no pair is lost."""
    done, links = leaves.filter(F.col("size") <= large).select("path", "sh"), []
    big = leaves.filter(F.col("size") > large)
    for turn in range(PIVOT_ROUNDS):
        if big.isEmpty():
            return done, links
        left, found = met_by_pivots(big, sketches, large, turn)
        links.append(found)
        done = done.unionByName(left.filter(F.col("size") <= large).select("path", "sh"))
        big = left.filter(F.col("size") > large)
    blocks = F.ceil(F.col("size") / large).cast("int")
    block = F.pmod(F.xxhash64("sh"), blocks).cast("int")
    tiles = big.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return done.unionByName(tiles.select(F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")).alias("path"), "sh")), links


def similar_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of the threshold or more, exactly."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    known, code = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(code, minlength=len(known)) > 1
    place = np.cumsum(shared) - 1
    code, owner = place[code[shared[code]]], owner[shared[code]]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = max(256, (4 << 20) // max(1, len(sets)))
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(code, [a, a + step])
        x = np.zeros((len(sets), step), np.float32)
        x[owner[lo:hi], code[lo:hi] - a] = 1
        both += x @ x.T
    either = sizes[:, None] + sizes[None, :] - both
    out = both.astype(np.float64) >= threshold * either - 1e-9
    np.fill_diagonal(out, False)
    return out


TILED = "sh long, linked long, u long, v long"


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows: root, i, j, block, sh, copies, text; sorted by the first three."""
    out: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["sh", "linked", "u", "v"])
    for (_, i, j), rows in _groups(batches, 3):
        texts = pa.array([r[6] for r in rows])
        sets = [s for _, _, data, offsets in text_chunks(texts, LITTLE) for s in shingle_sets(data, offsets)]
        near = similar_pairs(sets, threshold)
        if i != j:  # pairs inside a block belong to the block's own tile
            block = np.array([r[3] for r in rows])
            near &= block[:, None] != block[None, :]
        copies = np.array([r[5] for r in rows], np.int64)
        ids = [r[4] for r in rows]
        out += [(s, int(n), None, None) for s, n in zip(ids, near.astype(np.int64) @ copies, strict=True) if n]
        a, b = np.nonzero(np.triu(near))
        out += [(None, None, u, v) for u, v in _star([(ids[x], ids[y]) for x, y in zip(a, b, strict=True)])]
        if len(out) > 50_000:
            yield batch()
            out = []
    yield batch()


def joined(docs: DataFrame, threshold: float = THRESHOLD, small: int = SMALL_BUCKET, tile: int = TILE, large: int = LARGE_BUCKET, first: int = PIVOTS_FIRST) -> DataFrame:
    """One row per document: doc_id, th (hash of its text), class_id (the smallest doc_id that it is linked to, directly or
    over others, itself included) and n_links (documents of at least the threshold's similarity, copies included)."""
    rows = keyed(docs, F.col("doc_id").cast("long").alias("_id"))
    base = written(mapped(rows.select("did", "th", "text"), lambda b: _described(b, threshold), BASE), "sets")
    sketches = base.filter("n > 0").select("sh", "sketch").dropDuplicates(["sh"])
    leaves, by_pivots = all_leaves(base, sketches, small, large, first)
    bounded, more_pivots = bounded_buckets(written(leaves, "leaves"), sketches, large)
    filled_leaves = bounded.join(sketches, "sh").select("path", "sh", "sketch")
    links = mapped(filled_leaves.repartition("path").sortWithinPartitions("path"), lambda b: _linked(b, small), "u long, v long")
    for more in by_pivots + more_pivots:
        links = links.unionByName(more)
    found = components(links)
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "sh")
    sizes = members.groupBy("root").agg(F.count("*").alias("m"))
    # One text for each set that has anything near it.
    own = base.groupBy("sh").agg(F.count("*").alias("copies"), F.min(F.struct("did", "th")).alias("one"))
    own = members.join(sizes, "root").join(own, "sh").select("root", "m", "sh", "copies", F.col("one.did").alias("did"), F.col("one.th").alias("th"))
    texts = own.join(rows.select("did", "th", "text"), ["did", "th"]).groupBy("root", "m", "sh", "copies").agg(F.first("text").alias("text"))
    blocks = F.when(F.col("m") > 2 * tile, F.ceil(F.col("m") / tile)).otherwise(1).cast("int")
    tiled = texts.withColumn("nb", blocks).withColumn("block", F.pmod(F.xxhash64("sh"), F.col("nb")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tiled = tiled.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sh", "copies", "text")
    compared = written(mapped(tiled.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), lambda b: _compared(b, threshold), TILED), "compared")
    n_links = compared.filter("sh is not null").groupBy("sh").agg(F.sum("linked").alias("linked"))
    roots = components(compared.filter("u is not null").select("u", "v"))
    least = base.filter("n > 0").groupBy("sh").agg(F.count("*").alias("copies"), F.min("did").alias("least"))
    least = least.join(roots.withColumnRenamed("node", "sh"), "sh", "left").withColumn("root", F.coalesce("root", "sh")).join(n_links, "sh", "left")
    classes = least.groupBy("root").agg(F.min("least").alias("class_id"))
    per_set = least.join(classes, "root").select("sh", "root", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = base.select("did", "th", "sh", "n").join(per_set, "sh", "left")
    known = lambda c: F.when(F.col(c) != (1 << 63) - 1, F.col(c))
    return out.select(known("did").alias("doc_id"), "sh", F.col("root").alias("class_key"), "th", F.when(F.col("n") > 0, known("class_id")).otherwise(known("did")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") == 0).alias("empty"))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` without all but one of each class: the one with the smallest doc_id (null last), then of the
    smallest hash of its text; rows that agree in both are one row. Texts without words all stay."""
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("did"), "th")
    # The chosen rows' names are written before the texts move; the tables of the join are gone by then.
    chosen = lambda: joined(docs, **how).filter(~F.col("empty")).groupBy("class_key").agg(F.min(order).alias("one")).select("one.did", "one.th")
    first = settled(docs.sparkSession, "chosen", chosen)
    rows = keyed(docs, F.struct(*docs.columns).alias("_doc")).drop("text")
    one = rows.join(first, ["did", "th"], "left_semi").groupBy("did", "th").agg(F.first("_doc").alias("_doc"))
    return one.select("_doc.*").unionByName(docs.filter(~text_column().rlike(WORD_CLASS)))
