"""A Bloom filter of fixed size over all hashes of a corpus, counted once and twice.

Its size is a parameter and does not grow with the data, so it can be broadcast. When
it is overfull it lets more candidates through; it never loses one, so results do not depend on it.
A hash lies in one slice of the filter; slices are filled on the executors, as streams."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import U64, mapped, mix

LOG_BITS = 28
SLICE_BITS = 20
_FIELDS = pa.schema([("slice", pa.int32()), ("hashes", pa.binary())])


def _slices(log_bits: int) -> int:
    """Slices of 2**SLICE_BITS bits, as a power of two; at least 64 of them, so that as many tasks fill the filter."""
    return max(6, log_bits - SLICE_BITS)


def _places(h: np.ndarray, log_bits: int) -> list[np.ndarray]:
    """Three bit places of each hash, all in its slice."""
    s = _slices(log_bits)
    g, mask = mix(h), U64((1 << (log_bits - s)) - 1)
    base = (h >> U64(64 - s)) << U64(log_bits - s)
    return [(base | ((g >> U64(shift)) & mask)).astype(np.int64) for shift in (0, 21, 42)]


def by_slice(h: np.ndarray, log_bits: int) -> pa.RecordBatch:
    """Hashes as one row for each slice."""
    h, s = np.sort(h), _slices(log_bits)
    cut = np.searchsorted(h, np.arange(1, 1 << s, dtype=U64) << U64(64 - s))
    parts = [(i, x.tobytes()) for i, x in enumerate(np.split(h, cut)) if len(x)]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], schema=_FIELDS)


def _fill(batches: Iterator[pa.RecordBatch], log_bits: int) -> Iterator[pa.RecordBatch]:
    size = 1 << (log_bits - _slices(log_bits))
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            once, twice = found.setdefault(i, [np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)])
            places = np.sort(np.concatenate(_places(np.frombuffer(blob.as_buffer(), U64), log_bits)) - i * size)
            again = np.unique(places[1:][places[1:] == places[:-1]])
            own = np.zeros(size, bool)
            own[places] = True
            own = np.packbits(own, bitorder="little")
            more = np.zeros(size, bool)
            more[again] = True
            twice |= (once & own) | np.packbits(more, bitorder="little")
            once |= own
    for i, bits in found.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), **{n: [zlib.compress(x.tobytes(), 1)] for n, x in zip(("once", "twice"), bits, strict=True)}})


def fill(docs: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log_bits: int = LOG_BITS, which: tuple[str, ...] = ("once", "twice")) -> list[np.ndarray]:
    """The bits set once or more, or twice or more, over what `hashes` gives for each batch of `docs`; slices come to the driver compressed."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for h in hashes(batch):
                held.append(h)
                n += len(h)
                if n >= 1 << 20:
                    yield by_slice(np.concatenate(held), log_bits)
                    held, n = [], 0
        if n:
            yield by_slice(np.concatenate(held), log_bits)

    rows = mapped(docs, sliced, "slice int, hashes binary").repartition(1 << _slices(log_bits), "slice")
    filled = mapped(rows, lambda b: _fill(b, log_bits), "slice int, once binary, twice binary").select("slice", *which).collect()
    out = [np.zeros((1 << _slices(log_bits), 1 << (log_bits - _slices(log_bits) - 3)), np.uint8) for _ in which]
    while filled:
        row = filled.pop()
        for bits, name in zip(out, which, strict=True):
            bits[row["slice"]] = np.frombuffer(zlib.decompress(row[name]), np.uint8)
    return [bits.reshape(-1) for bits in out]


def test(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may have been put in."""
    log_bits = (len(bits) * 8).bit_length() - 1
    live = np.arange(len(h))
    for k in range(3):
        place = _places(h[live], log_bits)[k]
        live = live[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(h), bool)
    out[live] = True
    return out


_OPEN: dict[str, np.ndarray] = {}


def share(spark: SparkSession, bits: np.ndarray) -> Broadcast:
    """The filter for all executors, compressed: filters are sparse, and each executor writes down what is broadcast."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, zlib.compress(bits.tobytes(), 1)))


def shared(of: Broadcast) -> np.ndarray:
    key, packed = of.value
    if key not in _OPEN:
        while len(_OPEN) >= 3:
            _OPEN.pop(next(iter(_OPEN)))
        _OPEN[key] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return _OPEN[key]
