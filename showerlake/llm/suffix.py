"""Suffix-array dedup: bytes covered by a string of `length` bytes that starts anywhere else.

Every window of `length` bytes picks its anchor, the leftmost K-byte string of the smallest
hash in it, so equal windows pick equal anchors at equal distances. Neighbouring windows with one
anchor make a segment. Anchors of a hash met twice (a filter of fixed size, see filters.py)
emit their segments; segments of one hash meet in one place, where a suffix array of
them is built by two-stage sorting and adjacent common prefixes show the repeated windows.

Equal segments meet once: they are grouped by content before, so a passage or document of
any number of copies is one row, and its windows are repeated without sorting.
The segments of one hash that differ are sorted together; where they exceed `group_bytes` in all,
their windows are grouped by hash over the cluster instead, so no task holds such a group.

Null texts are empty. Other columns pass through. A text beyond one chunk is cut like any other; its anchors are
found part by part, its hashes stand in one task. Rows that are equal in doc_id and text are copies like any others: a long one loses
all its bytes. Matches never cross texts. Places are bytes of UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters
from .common import U64, filled, mapped, mix, powers, settled, signed, text_chunks, written
from .substring import keyed

LENGTH = 400
GRAM = 32
GROUP_BYTES = 4 << 20
BATCH_BYTES = 256 << 10
LOG_BITS = 26
SEPARATOR = b"\xff"  # never a byte of UTF-8


# --- two-stage suffix sorting -------------------------------------------------------------------


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one is not."""
    n = len(t)
    diff = np.flatnonzero(t[:-1] != t[1:])
    if not len(diff):
        return np.zeros(n, bool)
    following = np.searchsorted(diff, np.arange(n))
    out = np.zeros(n, bool)
    has = following < len(diff)
    at = diff[following[has]]
    out[has] = t[at] < t[at + 1]
    return out


def _sorted_directly(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at `at`, sorted by their first `depth` bytes: by eight bytes at once, then runs of ties by comparison."""
    raw = t.tobytes()
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(U64)
    key = np.zeros(len(at), U64)
    for j in range(8):
        key = (key << U64(8)) | padded[at + j]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    for a, b in zip(edge[:-1][np.diff(edge) > 1], edge[1:][np.diff(edge) > 1], strict=True):
        at[a:b] = sorted(at[a:b].tolist(), key=lambda i: raw[i : i + depth])
    return at


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of t in the order of their first `depth` bytes at least.

    Only suffixes smaller than their successors are sorted directly. A bucket is the suffixes of one
    first byte; in it, those larger than their successors come first, and they are induced
    by scanning the buckets in order: each scanned suffix puts the one before it at
    the end of what its bucket has so far."""
    n = len(t)
    small = smaller_than_next(t)
    direct = _sorted_directly(t, np.flatnonzero(small), depth)
    firsts = t[direct]
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)):
        done = []
        while induced[c]:  # a suffix may induce its neighbour into its own bucket
            now = np.concatenate(induced[c])
            induced[c] = []
            done.append(now)
            before = now[now > 0] - 1
            before = before[(t[before] == c) & ~small[before]]
            if len(before):
                induced[c].append(before)
        whole = np.concatenate([*done, direct[np.searchsorted(firsts, c) : np.searchsorted(firsts, c, "right")]])
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[~small[before] & (t[before] > c)]
        if len(before):
            to = t[before]
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            for part in np.split(before, np.flatnonzero(to[1:] != to[:-1]) + 1):
                induced[t[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the suffixes at a[i] and b[i] have in common, up to `most`; eight bytes at a time."""
    padded = np.concatenate([t, np.zeros(most + 16, np.uint8)]).astype(U64)
    eight = sum((padded[j : len(padded) - 8 + j] << U64(8 * j) for j in range(1, 8)), padded[: len(padded) - 8])
    out, live = np.full(len(a), most, np.int64), np.arange(len(a))
    for k in range(0, most, 8):
        x = eight[a[live] + k] ^ eight[b[live] + k]
        ended = x != 0
        if ended.any():
            first = ((x[ended, None] >> (U64(8) * np.arange(8, dtype=U64))) & U64(255) != 0).argmax(1)
            out[live[ended]] = np.minimum(most, k + first)
            live = live[~ended]
        if not len(live):
            break
    return out


def repeated_starts(segments: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows (all that fit into it) start in another place of the segments too."""
    t = np.frombuffer(SEPARATOR.join(segments) + SEPARATOR, np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in segments])])[:-1]
    windows = np.zeros(len(t), bool)
    for s, n in zip(starts, counts, strict=True):
        windows[s : s + n] = True
    order = suffix_array(t, length)
    order = order[windows[order]]
    a, b = order[:-1], order[1:]
    met = common_prefixes(t, a, b, length) == length
    hit = np.zeros(len(t), bool)
    hit[a[met]] = hit[b[met]] = True
    return [hit[s : s + n] for s, n in zip(starts, counts, strict=True)]


# --- anchors and segments --------------------------------------------------------------------------


def _gram_values(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings."""
    n = len(data) - GRAM + 1
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.empty(len(data), U64)
    for j in range(8):  # eight bytes from every place
        m = (len(data) - j + 7) // 8
        eight[j::8] = np.frombuffer(padded[j : j + 8 * m].tobytes(), U64)[: len(eight[j::8])]
    h = eight[:n] * U64(0x9E3779B97F4A7C15)
    for k, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> U64(29)
        h += eight[k : k + n]
        h *= U64(c)
    return h ^ (h >> U64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, U64)
    padded[: len(x)] = x
    blocks = padded.reshape(rows, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, text, first window, number of windows) of every segment; windows are places in `data`."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, U64), none, none, none
    values = _gram_values(data)
    if len(values) >= 1 << 24:  # a very long text: the same, part by part
        parts, step = [], 1 << 23
        for at in range(0, len(data) - length + 1, step):
            h, doc, p, n = segments_of(data[at : at + step + length - 1], np.clip(offsets - at, 0, min(step + length - 1, len(data) - at)), length)
            parts.append((h, doc, p + at, n))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    w = length - GRAM + 1
    least = _sliding_min((values & ~U64(0xFFFFFF)) | np.arange(len(values), dtype=U64), w)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + length <= ends)
    if not len(at):
        return np.zeros(0, U64), none, none, none
    anchor = (least[at] & U64(0xFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    return mix(values[anchor[first]]), np.searchsorted(offsets, at[first], "right") - 1, at[first], n


def _anchors(batch: pa.RecordBatch, length: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_chunks(filled(batch)):
        yield segments_of(data, offsets, length)[0]


SEGMENTS = "h long, fp long, did long, th long, at long, n int, segment binary"


def _segments(batches: Iterator[pa.RecordBatch], length: int, twice: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, _, data, offsets in text_chunks(filled(batch)):
            h, doc, at, n = segments_of(data, offsets, length)
            live = filters.test(filters.shared(twice), h)
            h, doc, at, n = h[live], doc[live], at[live], n[live]
            if not len(h):
                continue
            sums = np.zeros(len(data) + 1, U64)
            np.cumsum(mix(data.astype(U64) + U64(1)) * powers(len(data))[: len(data)], out=sums[1:])
            end = at + n + length - 1
            fp = mix((sums[end] - sums[at]) * powers(len(data), True)[at] + n.astype(U64))
            raw = data.tobytes()
            _, one = np.unique(np.column_stack([h, fp]), axis=0, return_index=True)
            carried: list[bytes | None] = [None] * len(h)  # equal segments of a chunk send their text once
            for i in one.tolist():
                carried[i] = raw[at[i] : end[i]]
            yield pa.RecordBatch.from_pydict({"h": signed(h), "fp": signed(fp), "did": dids[first + doc], "th": ths[first + doc], "at": at - offsets[doc], "n": n.astype(np.int32), "segment": pa.array(carried, pa.binary())})


MARKS = "h long, fp long, starts array<int>, ends array<int>"


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge[::2].astype(np.int32), edge[1::2].astype(np.int32)


def _marked(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h: whole groups are gathered up to BATCH_BYTES and sorted by one suffix array."""
    held: list[list[tuple]] = []
    group: list[tuple] = []
    size = 0

    def marks() -> pa.RecordBatch:
        rows = [r for g in held if len(g) > 1 for r in g]
        out = []
        if rows:
            hits = repeated_starts([r[3] for r in rows], [r[2] for r in rows], length)
            out = [(r[0], r[1], *_runs(x)) for r, x in zip(rows, hits, strict=True) if x.any()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int32())), pa.array([r[3] for r in out], pa.list_(pa.int32()))], names=["h", "fp", "starts", "ends"])

    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if group and row[0] != group[0][0]:
                if len(group) > 1:
                    held.append(group)
                    size += sum(len(r[3]) for r in group)
                group = []
                if size >= BATCH_BYTES:
                    yield marks()
                    held.clear()
                    size = 0
            group.append(row)
    if len(group) > 1:
        held.append(group)
    if held:
        yield marks()


def _hashed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of the segments as its hash."""
    for batch in batches:
        for h, fp, n, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = np.frombuffer(segment, np.uint8)
            sums = np.zeros(len(data) + 1, U64)
            np.cumsum(mix(data.astype(U64) + U64(1)) * powers(len(data))[: len(data)], out=sums[1:])
            at = np.arange(n)
            w = mix((sums[at + length] - sums[at]) * powers(len(data), True)[at])
            yield pa.RecordBatch.from_pydict({"w": signed(w), "h": np.full(n, h), "fp": np.full(n, fp), "place": at.astype(np.int32)})


def repeated_bytes(docs: DataFrame, length: int = LENGTH, log_bits: int = LOG_BITS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """did, th and ranges of window starts (from, to) whose window also starts anywhere else."""
    rows = keyed(docs)
    [twice] = filters.fill(rows.select("text"), lambda b: _anchors(b, length), log_bits, ("twice",))
    twice = filters.share(docs.sparkSession, twice)
    segments = written(mapped(rows.select("did", "th", "text"), lambda b: _segments(b, length, twice), SEGMENTS), "segments")
    # max() skips the nulls that stand for texts sent by another row
    kinds = segments.groupBy("h", "fp").agg(F.max("segment").alias("segment"), F.count("*").alias("times"), F.first("n").alias("n"))
    owners = segments.groupBy("h", "fp").agg(F.count("*").alias("times"), F.first("n").alias("n"))
    copied = owners.filter("times > 1").select("h", "fp", F.array(F.lit(0)).alias("starts"), F.array("n").alias("ends"))
    sizes = owners.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + F.lit(length)).alias("bytes")).filter("kinds > 1")
    kinds = kinds.join(sizes, "h").select("h", "fp", "n", "segment", "bytes")
    small = kinds.filter(F.col("bytes") <= group_bytes).drop("bytes").repartition("h").sortWithinPartitions("h")
    sorted_ = mapped(small, lambda b: _marked(b, length), MARKS)
    found = copied.unionByName(sorted_)
    if not sizes.filter(F.col("bytes") > group_bytes).isEmpty():
        large = mapped(kinds.filter(F.col("bytes") > group_bytes).drop("bytes"), lambda b: _hashed(b, length), "w long, h long, fp long, place int")
        again = large.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
        hashed = large.join(again, "w").select("h", "fp", F.array("place").alias("starts"), F.array(F.col("place") + 1).alias("ends"))
        found = found.unionByName(hashed)
    # One row for each kind of segment, so that its owners meet it once however many ranges it has.
    each = found.groupBy("h", "fp").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("rs"))
    # Periodic texts own one kind many times: a row for each document, with its places. Rows that are equal share them.
    owned = segments.groupBy("h", "fp", "did", "th").agg(F.collect_set("at").alias("ats"))
    met = owned.join(each, ["h", "fp"])
    placed = F.flatten(F.transform("ats", lambda at: F.transform("rs", lambda r: F.struct((at + r["starts"]).alias("a"), (at + r["ends"]).alias("b")))))
    return met.groupBy("did", "th").agg(F.flatten(F.collect_list(placed)).alias("ranges"))


def covered(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte spans (start, end) covered by the windows that start in the ranges, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        end = b + length - 1
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((a, end))
    return out


DONE = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, _kept string"


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts = filled(batch, "_text").cast(pa.large_binary()).to_pylist()
        ranges = batch.column(names.index("ranges")).to_pylist()
        out = []
        for raw, found in zip(texts, ranges, strict=True):
            spans = covered([(r["a"], r["b"]) for r in found], length) if found else []
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            whole = b"".join([*kept, raw[at:]]) if spans else raw
            # spans are bytes: a cut inside a character leaves parts of it, which no text can hold
            out.append((len(raw), len(raw) - len(whole), len(spans), hashlib.sha256(whole).hexdigest(), whole.decode("utf-8", "ignore") if with_text else None))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        own = [i for i, c in enumerate(names) if c not in ("_text", "ranges")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*(names[i] for i in own), "n_bytes", "n_removed", "n_spans", "kept_sha256", "_kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, **how) -> DataFrame:
    """The rows of `docs` with n_bytes, n_removed, n_spans, kept_sha256 and (with_text; else null) the kept text as `_kept`.

    `docs` must not have columns of these names; one that may have them is passed as a struct (see corpus_pipeline.py)."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    clash = {c.lower() for c in docs.columns} & {c.split()[0] for c in DONE.split(", ")}
    if clash:
        raise ValueError(f"the rows have columns {', '.join(sorted(clash))}")
    # The ranges are written before the texts move, so that segments and their shuffles are gone by then.
    found = settled(docs.sparkSession, "ranges", lambda: repeated_bytes(docs, length, **how))
    own = [c for c in docs.columns if c != "text"]
    rows = keyed(docs, *[F.col(c).alias(f"_own_{i}") for i, c in enumerate(own)])
    met = rows.join(found, ["did", "th"], "left").select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(own)], F.col("text").alias("_text"), "ranges")
    schema = StructType([*[docs.schema[c] for c in own], *_parse_datatype_string(DONE).fields])
    return mapped(met, lambda b: _cut(b, length, with_text), schema)
