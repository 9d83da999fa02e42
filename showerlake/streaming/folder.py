"""A folder into which files are dropped: each is loaded once, however often the job runs."""

from __future__ import annotations

import re
import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import files as fs

FILES = "path string, modificationTime timestamp, length long, content binary"
LOG = "file string, dataset string, action string, detail string"


def ingest_folder(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: StructType) -> DataFrame:
    """Append the rows of files that this checkpoint has not seen, then stop."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(target)


def dataset_name(path: str) -> str | None:
    """A file's name without its ending, in small letters, digits and underscores; none where nothing is left, or it starts with a digit."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    name = re.sub("[^a-z0-9]+", "_", stem).strip("_")
    return name if name and not name[0].isdigit() else None


def kind_of(spark: SparkSession, path: str, form: str) -> str | None:
    """The kind of file, by its columns: the one with most pinned columns of those that are all there."""
    have = set((spark.read.option("header", True).csv(path) if form == "csv" else spark.read.parquet(path)).columns)
    fits = [k for k in fs.KINDS if have >= set(fs.schema(k).names)]
    return max(fits, key=lambda k: len(fs.schema(k).names), default=None)


def load_file(spark: SparkSession, path: str, root: str) -> tuple[str | None, str, str]:
    """What became of one file: (dataset, action, detail). A dataset is never written over, and one whose checks fail is not published."""
    name, form = dataset_name(path), "csv" if path.lower().endswith(".csv") else "parquet"
    if name is None:
        return None, "invalid_name", "no dataset can be named after this file"
    if found := fs.versions(spark, f"{root}/{name}"):
        return name, "exists", f"version {found[0]['version']} is published"
    try:
        kind = kind_of(spark, path, form)
        if kind is None:
            return name, "rejected", "its columns are of no known kind"
        fs.ingest(spark, path, f"{root}/{name}", kind, form)
    except (PySparkException, Py4JJavaError, ValueError, TypeError) as e:
        return name, "rejected", str(e).split("\n", 1)[0][:400]
    return name, "loaded", kind


def ingest_datasets(spark: SparkSession, folder: str, root: str, checkpoint: str, settle: float = 30.0, clock=time.time) -> DataFrame:
    """Each new CSV or Parquet file of a folder becomes a dataset under `root`, named after it: validated, staged, checked, and only
    then published. Returns the log: a row for each file that was ever decided (loaded, exists, rejected, invalid_name), and one
    for the first that still waits (unsettled).

    The stream is of files, not of rows, one a batch in the order in which they were last written; contents are read by the
    ingest alone. A file written within the last `settle` seconds may still grow. All after it are younger still, so the
    stream stops there without a commit, and the next run meets that file again as it then is. A file that can't be read, or whose
    checks fail, is logged and does not stop the others. A run that is lost between publishing and its commit finds the
    dataset there and logs `exists`: nothing is loaded twice. Hidden files and those named `~...` are passed over."""
    waiting: list[tuple] = []

    def decide(files: DataFrame, batch: int) -> None:
        log = []
        for path, written in files.select("path", F.unix_micros("modificationTime")).collect():  # one file
            age = clock() - written / 1e6
            if age < settle:
                waiting.append((path, dataset_name(path), "unsettled", f"written {max(0.0, age):.0f} s ago"))
                raise InterruptedError("a file may still grow")
            if not path.rsplit("/", 1)[-1].startswith("~"):
                log.append((path, *load_file(spark, path, root)))
        spark.createDataFrame(log, LOG).coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/decided/batch={batch}")

    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.{csv,parquet,CSV,PARQUET}").load(folder)
    query = files.select("path", "modificationTime").writeStream.foreachBatch(decide).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not waiting:
            raise
    return decided(spark, checkpoint).unionByName(spark.createDataFrame(waiting, LOG))


def decided(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The log of all runs so far."""
    try:
        return spark.read.schema(LOG).parquet(f"{checkpoint}/decided").select(*[c.split()[0] for c in LOG.split(", ")])
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)
