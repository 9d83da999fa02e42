"""A deterministic, sharded writer of WARC 1.1 archives, and their reader.

Records are sorted by (page_id, payload digest) over ranges whose borders come from the rows alone: from a
sample chosen by a hash of the rows, weighed by bytes, and never from how the input lies. One task writes one range (a
shard). It rolls over to a new file once a file has `roll_bytes` compressed bytes; every record is a gzip member of its own
without a time stamp. Headers, record ids and digests are made anew from the payload. So the same rows give the same
files, byte for byte.

Each attempt of a task writes under a temporary name of its own and returns its files as rows of a
manifest; only attempts that Spark accepts get into it. The manifest is stored, the files it names are moved to their
final names (moving can be repeated), and then the final manifest is stored. Readers take files from that manifest alone, so files of lost
attempts are never seen.

Of records with equal payloads of at least `least_bytes` bytes the one with the smallest page_id is the response, the others are
revisits that hold no payload, but its length and digest; smaller payloads are responses always.

Null html is an empty payload; a null page_id sorts last and is written without an id, so a revisit of it refers to null. A null url
leaves out the target; control characters and blanks of a url are percent-encoded. Rows that agree in page_id and payload are records each, and
the first by url is the response. Very many equal rows (over a thousandth of all) are counted first, carry
one payload and are dealt over the shards as counts. An empty table gives an archive without files. Other columns
are not looked at. A payload of any length is one record, held by one task at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, written

LEAST_BYTES = 100
SHARD_BYTES, MOST_SHARDS = 32 << 20, 20_000
ROLL_BYTES = 64 << 20
SAMPLES_PER_SHARD = 32
#: Compressed bytes that one reading task gets, about; more where there are over ten thousand tasks.
READ_BYTES = 4 << 20
#: Equal rows beyond so many, and beyond a thousandth of all rows, are counted first; so there are at most a thousand such groups.
FLOOD = 1 << 16
COPIES_AT_ONCE = 4096
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "shard int, file int, temporary string, name string, bytes long, sha256 string, records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
ROWS = "page_id long, url string, digest string, n_bytes long, payload binary, refers_to long, mark boolean, block int, times int"
NO_ID = np.iinfo(np.int64).max


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('|'.join(map(str, parts)).encode()).digest()[:16], version=5)}>"


def _member(fields: dict[str, object], block: bytes, level: int) -> bytes:
    fields = fields | {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": len(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", level, mtime=0)


def _target(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


class _Shard:
    """The files of one shard, under temporary names."""

    def __init__(self, root: str, shard: int, roll_bytes: int, level: int):
        self.store, top = fs.FileSystem.from_uri(root)
        self.folder = f"{top}/_temporary/{uuid.uuid4().hex}"
        self.store.create_dir(self.folder)
        self.shard, self.roll_bytes, self.level, self.files, self.out, self.count = shard, roll_bytes, level, [], None, 0
        self.seen: tuple | None = None

    def add(self, page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers: tuple | None, single: bool) -> None:
        """refers: (page_id of the response,) for a revisit; single: the only response with this page_id and payload."""
        self.count += 1
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
        fields = {
            "WARC-Type": "revisit" if refers else "response",
            "WARC-Record-ID": _record_id(page_id, digest) if single else _record_id(page_id, digest, self.shard, self.count),
            "WARC-Date": DATE, "WARC-Target-URI": _target(url), "X-Page-Id": page_id, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response",
        }
        if refers:
            fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers[0], digest), "X-Refers-To-Page-Id": refers[0]}
        self.put(_member(fields, http if refers else http + payload, self.level))

    def put(self, member: bytes) -> None:
        if self.out is not None and self.size >= self.roll_bytes:
            self.close()
        if self.out is None:
            name = f"part-{self.shard:06d}-{len(self.files):04d}.warc.gz"
            self.out, self.size, self.sha, self.records, self.name = self.store.open_output_stream(f"{self.folder}/{name}", compression=None), 0, hashlib.sha256(), 0, name
            self.write(_member({"WARC-Type": "warcinfo", "WARC-Record-ID": _record_id("warcinfo", name), "WARC-Date": DATE, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n", self.level))
        self.write(member)
        self.records += 1

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append((self.shard, len(self.files), f"{self.folder}/{self.name}", self.name, self.size, self.sha.hexdigest(), self.records))
            self.out = None


def _write_shard(root: str, roll_bytes: int, least_bytes: int, level: int) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, mark, taken = None, None, None
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)) for c in ("shard", "page_id", "url", "digest", "n_bytes", "payload", "refers_to", "mark", "block", "times")]
            for values in zip(*columns, strict=True):
                number, page_id, url, digest, n_bytes, payload, refers_to, is_mark, block, times = (v.as_py() for v in values)
                shard = shard or _Shard(root, number, roll_bytes, level)
                if is_mark:  # stands before the rows of its page_id and payload
                    mark = (page_id, digest, refers_to)
                    continue
                marked = mark is not None and mark[:2] == (page_id, digest)
                for _ in range(times):
                    first = not block and taken != (page_id, digest)
                    if n_bytes < least_bytes:
                        shard.add(page_id, url, payload, n_bytes, digest, None, False)
                    elif block:
                        shard.add(page_id, url, None, n_bytes, digest, (refers_to,), False)
                    elif not marked or mark[2] == page_id and first:
                        shard.add(page_id, url, payload, n_bytes, digest, None, True)
                        taken = (page_id, digest)
                    else:
                        shard.add(page_id, url, None, n_bytes, digest, (mark[2],), False)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*shard.files, strict=True)], ["shard", "file", "temporary", "name", "bytes", "sha256", "records"]).cast(pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("records", pa.int64())]))

    return step


def _borders(keys: DataFrame, n_rows: int, n_shards: int) -> list[tuple[int, str, int]]:
    """Keys at which shards begin: equal shares of the bytes of a sample that a hash of the rows chooses, so it depends on the rows alone."""
    if n_shards == 1:
        return []
    every = max(1, n_rows // (SAMPLES_PER_SHARD * n_shards))
    drawn = keys.filter(F.pmod(F.xxhash64("page_id", "url", "digest", "block"), F.lit(every)) == 0)
    sample = drawn.groupBy(F.coalesce("page_id", F.lit(NO_ID)).alias("p"), "digest", "block").agg(F.sum(F.col("n_bytes") + 512).alias("w")).orderBy("p", "digest", "block").toPandas()
    if not len(sample):
        return []
    before = sample["w"].cumsum() - sample["w"]
    shard = (before * n_shards // sample["w"].sum()).astype(int)
    firsts = sample[shard != shard.shift(fill_value=0)]
    return list(zip(firsts["p"].tolist(), firsts["digest"].tolist(), firsts["block"].tolist(), strict=True))


def _shard_of(borders: list[tuple[int, str, int]]) -> Callable[..., Column]:
    ids = np.array([b[0] for b in borders], np.int64)

    @F.pandas_udf("int")
    def shard(page_id: pd.Series, digest: pd.Series, block: pd.Series) -> pd.Series:
        p = page_id.to_numpy(np.int64)
        low, high = np.searchsorted(ids, p, "left"), np.searchsorted(ids, p, "right")
        for i in np.flatnonzero(low != high):  # a border inside this id's rows
            high[i] = bisect_right(borders, (int(p[i]), digest.iat[i], int(block.iat[i])))
        return pd.Series(high, dtype="int32")

    return shard


def _rows(base: DataFrame, keys: DataFrame, n_rows: int, least_bytes: int, flood: int) -> DataFrame:
    """Records and marks, as ROWS: a mark tells a (page_id, payload) that occurs with others to which page it refers."""
    none = lambda kind: F.lit(None).cast(kind)
    shared = keys.filter(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    marks = keys.select("page_id", "digest").join(shared, "digest").select("page_id", none("string").alias("url"), "digest", F.lit(0).cast("long").alias("n_bytes"), none("binary").alias("payload"), "refers_to", F.lit(True).alias("mark"), F.lit(0).alias("block"), F.lit(1).alias("times"))
    names = ["page_id", "url", "digest"]
    heavy = keys.groupBy(*names, "n_bytes").agg(F.count("*").alias("copies")).filter(F.col("copies") > max(flood, n_rows // 1000)).collect()
    as_rows = lambda df, refers, block, times: df.select("page_id", "url", "digest", "n_bytes", "payload", refers.alias("refers_to"), F.lit(False).alias("mark"), block.alias("block"), times.alias("times"))
    if heavy:
        spark = base.sparkSession
        groups = spark.createDataFrame(heavy, "page_id long, url string, digest string, n_bytes long, copies long")  # at most a thousand
        hot = F.broadcast(groups.select(*[F.col(n).alias(f"h_{n}") for n in names], "copies"))
        on = F.lit(True)
        for n in names:
            on = on & base[n].eqNullSafe(F.col(f"h_{n}"))
        heads = base.join(hot, on).groupBy(*names, "n_bytes", "copies").agg(F.first("payload").alias("payload"))
        refers = F.broadcast(shared.join(F.broadcast(groups.select("digest").distinct()), "digest"))  # as few
        blocks = heads.join(refers, "digest", "left").withColumn("block", F.explode(F.expr(f"sequence(1, cast(ceil((copies - 1) / {COPIES_AT_ONCE}) as int))")))
        times = F.least(F.lit(COPIES_AT_ONCE), F.col("copies") - 1 - (F.col("block") - 1) * COPIES_AT_ONCE).cast("int")
        small = F.when(F.col("n_bytes") < least_bytes, F.col("payload"))
        rest = as_rows(base.join(hot, on, "left_anti"), none("long"), F.lit(0), F.lit(1))
        return marks.unionByName(rest).unionByName(as_rows(heads, none("long"), F.lit(0), F.lit(1))).unionByName(as_rows(blocks.withColumn("payload", small), F.col("refers_to"), F.col("block"), times))
    return marks.unionByName(as_rows(base, none("long"), F.lit(0), F.lit(1)))


def _moved(root: str) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        for b in batches:
            for temporary, name, size in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                there, done = store.get_file_info([temporary, f"{top}/{name}"])
                if there.type != fs.FileType.NotFound:
                    store.move(temporary, f"{top}/{name}")
                elif done.size != size:  # an earlier attempt of this task has not moved it either
                    raise OSError(f"{name} is neither under its temporary nor its final name")
            yield b

    return step


def write_warc(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, least_bytes: int = LEAST_BYTES, level: int = 6, flood: int = FLOOD) -> DataFrame:
    """Write `pages` (page_id, url, html) as an archive under the URI `root`; the manifest that names its files."""
    spark = pages.sparkSession
    store, top = fs.FileSystem.from_uri(root)
    if store.get_file_info(f"{top}/_manifest/_SUCCESS").type != fs.FileType.NotFound:
        raise FileExistsError(f"{root} holds an archive")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"), payload.alias("payload"))
    keys = written(base.drop("payload"), "warc-keys")
    n_rows, n_bytes = keys.agg(F.count("*"), F.coalesce(F.sum(F.col("n_bytes") + 512), F.lit(0))).first()
    n_shards = max(1, -(-n_bytes // max(shard_bytes, n_bytes // MOST_SHARDS)))
    rows = _rows(base, keys, n_rows, least_bytes, flood)
    borders = _borders(keys.withColumn("block", F.lit(0)), n_rows, n_shards)
    number = _shard_of(borders)(F.coalesce("page_id", F.lit(NO_ID)), "digest", "block") if borders else F.lit(0)
    number = F.when(F.col("block") > 0, F.pmod(F.xxhash64("page_id", "url", "digest", "block"), F.lit(len(borders) + 1)).cast("int")).otherwise(number)
    dealt = rows.withColumn("shard", number).repartitionById(len(borders) + 1, F.col("shard")).sortWithinPartitions(F.asc_nulls_last("page_id"), "digest", F.desc("mark"), "block", "url")
    pending = written(mapped(dealt, _write_shard(root, roll_bytes, least_bytes, level), MANIFEST), "warc-pending")
    mapped(pending.repartition(max(1, min(1000, len(borders) + 1)), "name"), _moved(root), MANIFEST).write.mode("overwrite").parquet(f"{root}/_manifest")
    if store.get_file_info(f"{top}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{top}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an opened archive file."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:80]!r}")
            fields = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode().partition(":")
                fields[name] = value.strip()
            block = f.read(int(fields["Content-Length"]))
            if len(block) != int(fields["Content-Length"]):
                raise ValueError("a record ends early")
            yield fields, block


def _read(root: str) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for name in b.column(0).to_pylist():
                found, held = [], 0
                with store.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for fields, block in records(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
                        if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"] or not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a record differs from its digest")
                        found.append((number(fields.get("X-Page-Id")), fields.get("WARC-Target-URI"), int(http["Content-Length"]) if revisit else len(payload), digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-Id")), None if revisit else payload))
                        held += len(block) + 256
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                            found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return step


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """The records of an archive that write_warc has written, as RECORD; a payload that differs from its digest is an error."""
    files = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")
    n_bytes = files.agg(F.sum("bytes")).first()[0] or 0
    return mapped(files.select("name").repartition(max(1, min(10_000, -(-n_bytes // READ_BYTES))), "name"), _read(root), RECORD)
