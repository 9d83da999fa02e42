"""What the operators of this subpackage share: words, chunks of text, written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import deleted, shuffles_dropped

#: A word is a longest run of characters other than these white-space characters.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: Bytes of text that one step of the vectorised code takes at once.
CHUNK_BYTES = 2 << 20
#: The same where many arrays of a chunk's length stand beside each other.
LITTLE = 512 << 10

#: Bytes of rows that a Python worker gets at once, at most (one row more where rows are longer): both sides hold them whole.
ARROW_BYTES = 8 << 20

U64 = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE.encode())] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Tables written inside `settled`, to be removed at its end.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(name: str = "text") -> Column:
    """The text; a null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir; set here only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with a number after it if `df` has such a column."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: its lineage ends here, and a lost executor costs none of it."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows that `build` gives, written. The tables that it wrote on its way go, since nothing else reads them."""
    own: list[str] = []
    try:
        token = _PASSING.set(own)
        try:
            with shuffles_dropped(spark):
                df = build()
        finally:
            _PASSING.reset(token)
        return written(df, name)
    finally:
        for path in own:
            deleted(spark, path)


def mapped(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of bounded bytes: the default counts rows, and ten thousand long texts fill a worker.

    The bound is the session's own setting, lowered if it is higher and never raised."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(conf.get(key)) > ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return df.mapInArrow(step, schema)


def _bytes(setting: str) -> int:
    """A size as Spark writes it: a number of bytes, or with a unit after it."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", setting.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit.removesuffix("b") or unit]


def crc_mod(column: str, by: int) -> Column:
    """crc32 of the id as decimal text, modulo `by`; 0 for a null id has no meaning, so it is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column into (first row, end row, UTF-8 bytes, offsets): whole texts, about `most` bytes at a time.

    A text longer than that is a chunk of its own. Nulls must have been filled."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, end, data[ends[at] : ends[end]], ends[at : end + 1] - ends[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of a public 64-bit hash)."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, or of its inverse."""
    found = _POWERS.get(inverse)
    if found is None or len(found) <= n:
        out = np.full(max(n + 1, CHUNK_BYTES + 1), _INVERSE if inverse else _BASE, U64)
        out[0] = 1
        found = np.multiply.accumulate(out)
        if n <= 4 * CHUNK_BYTES:
            _POWERS[inverse] = found
    return found[: n + 1]


def words_of(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, text number) of every word; no word crosses two texts. `between`: for each byte, whether it parts words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~between[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, U64)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data), True)[starts] + (ends - starts).astype(U64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k neighbouring words, text borders not looked at."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= U64(0xD6E8FEB86659FD93)
        h += words[j : j + n]
    return mix(h)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)


def filled(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column
