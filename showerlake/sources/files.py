"""Typed sources, the sorted archive, and loading: nothing is inferred, and data is published only once it is checked."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..operators import checks as ck
from ..operators import events as ev
from ..operators import filters as fl
from .shared import deleted, scratch, shared_dir, shuffles_dropped  # noqa: F401

_TYPES = {"i": IntegerType(), "l": LongType(), "d": DoubleType(), "s": StringType()}
_COMMON = "event_number:l cell_id:l ix:i iy:i iz:i x:d y:d z:d xt:d yt:d zt:d xl:d yl:d zl:d energy:d theta:d phi:d p:d is_secondary:i particle_type:s parent_type:s daughter_type:s"
#: The pinned columns of each kind of file, in the order of a CSV header.
KINDS = {
    "two": _COMMON + " origin:s p_a:d p_b:d bin_a:i bin_b:i theta_a:d theta_b:d phi_a:d phi_b:d seg_pred:d seg_true:d gradcam:d shapcam:d energy_pred:d angle_pred:d",
    "one": _COMMON + " p_bin:i",
    "features": "event_number:l p:d theta:d phi:d p_bin:i n:l e:d label:i " + " ".join(f"{prefix}{n}:d" for prefix in ("", "trans_", "local_") for n in ev.FEATURES),
}
FEATURE_FRAMES = {"": "", "trans_": "t", "local_": "l"}
#: The derived tables of each kind.
RECIPES = {"two": ("projection", "events", "shape_sums", "layers", "profiles", "sample"), "one": ("projection", "events", "shape_sums", "layers", "profiles"), "features": ("events",)}


def schema(kind: str) -> StructType:
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split(":") for c in KINDS[kind].split())])


def read_hits_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A declared type for each column, an empty field is null, a wrong header or row is fatal."""
    return spark.read.schema(schema(kind)).option("header", True).option("nullValue", "").option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def _typed(c: StructField, have: str) -> Column:
    col = F.col(c.name)
    if isinstance(c.dataType, StringType):
        return F.nullif(col.cast("string"), F.lit(""))
    return (col.cast("int") if have == "boolean" else col).cast(c.dataType)


def read_hits_parquet(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Columns by name in any order, index columns of data frames ignored, each cast to its pinned type."""
    df = spark.read.parquet(path)
    have = dict(df.dtypes)
    missing = [c.name for c in schema(kind) if c.name not in have]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*[_typed(c, have[c.name]).alias(c.name) for c in schema(kind)])


def audit_source(df: DataFrame, kind: str) -> DataFrame:
    """Refuses columns of another class of type; counts integers out of their pinned range, per kind in one pass."""
    have = dict(df.dtypes)
    numbers = ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean")
    for c in schema(kind):
        if (have[c.name] == "string") != isinstance(c.dataType, StringType) or not (have[c.name] == "string" or have[c.name] in numbers or have[c.name].startswith("decimal")):
            raise TypeError(f"{c.name} is {have[c.name]}")
    wide = [c.name for c in schema(kind) if isinstance(c.dataType, IntegerType)]
    bad = sum(((~F.col(n).cast("double").between(-(2**31), 2**31 - 1)).cast("int") for n in wide), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(bad), F.lit(0)).alias("out_of_range"), F.lit(len(wide)).alias("integers"))


def nan_to_null(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with NaN as null, and how many each column had."""
    counts = df.agg(*[F.count_if(F.isnan(c)).alias(c) for c in columns])
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns}), counts


def write_archive(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet parts sorted by event (and cell), so that a filter on events skips most of them."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(parts, "event_number").sortWithinPartitions(*[c for c in ("event_number", "cell_id") if c in df.columns]).write.mode(mode).option("compression", "zstd").parquet(path)


def write_bucketed(df: DataFrame, path: str) -> DataFrame:
    """An archive in buckets of events, sorted by event (and cell) within each, as the table that knows it.

    Whatever groups by event, shower of an event or layer of an event then needs no shuffle, and a filter on one event reads one
    bucket. How many buckets there are is told by the folder's name, so `bucketed` finds the table again."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [c for c in ("event_number", "cell_id") if c in df.columns]
    name, path = f"archive_{uuid.uuid4().hex}", f"{path}-by-{n}"
    df.repartition(n, "event_number").write.bucketBy(n, "event_number").sortBy(*order).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """An archive that write_bucketed has written, in any session."""
    n, name = int(path.rsplit("-by-", 1)[1]), f"archive_{uuid.uuid4().hex}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema(kind).fields)
    order = ", ".join(c for c in ("event_number", "cell_id") if c in schema(kind).fieldNames())
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (event_number) SORTED BY ({order}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def read_archive(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    return spark.read.schema(schema(kind)).parquet(*paths)


def append_part(existing: DataFrame, incoming: DataFrame, offset: int = 0) -> DataFrame:
    """Both parts, the incoming one's events shifted; refuses other columns, and ranges of events that overlap."""
    if sorted(existing.columns) != sorted(incoming.columns):
        raise ValueError("the parts are of different kinds")
    moved = incoming.withColumn("event_number", F.col("event_number") + offset)
    ends = [df.agg(F.min("event_number"), F.max("event_number")).first() for df in (existing, moved)]
    (a0, a1), (b0, b1) = ends
    if None not in (a0, b0) and not (b0 > a1 or b1 < a0):
        raise ValueError(f"events overlap; an offset of {a1 + 1 - b0 + offset} would do")
    return existing.unionByName(moved)


def derive(archive: DataFrame, path: str, kind: str = "two") -> dict[str, DataFrame]:
    """The derived tables of an archive, each written once. Sums and profiles are per event and own shower."""
    if kind == "features":
        doubles = [n for n, t in archive.dtypes if t == "double"]
        tables = {"events": nan_to_null(archive, doubles)[0]}
    else:
        kept = archive.filter("energy > 0").withColumn("origin", F.lit("A")) if kind == "one" else fl.keep_hits(archive)
        keyed = kept.withColumn("b", fl.own_shower(F.col("origin")))
        tables = {
            "projection": kept.drop("origin") if kind == "one" else fl.project_rows(kept), "events": (ev.events_single if kind == "one" else ev.events_two)(kept),
            "shape_sums": ev.shape_sums(keyed, ("event_number", "b")), "layers": ev.layers(kept), "profiles": ev.profiles(kept), "sample": ev.sample10(kept),
        }
    for name in RECIPES[kind]:
        tables[name].write.option("compression", "zstd").parquet(f"{path}/{name}")
    return {name: archive.sparkSession.read.parquet(f"{path}/{name}") for name in RECIPES[kind]}


def ingest(spark: SparkSession, source: str, target: str, kind: str = "two", form: str = "parquet", consume: bool = False) -> dict[str, DataFrame]:
    """Validate, archive, derive, check, publish. With `consume` the source goes once all its rows are in the archive: for
    whoever made it for this ingest alone."""
    read = read_hits_csv if form == "csv" else read_hits_parquet
    with shuffles_dropped(spark):
        df = read(spark, source, kind)
        audit = audit_source(df, kind).first()
        if audit["out_of_range"]:
            raise ValueError("integers out of range")
        staged = f"{target}/staged-{uuid.uuid4().hex}"
        archive = write_bucketed(df, f"{staged}/archive")
        whole = archive.count() == audit["rows"]
        if consume and whole:
            deleted(spark, source)
        tables = derive(archive, staged, kind)
        failed = ck.failures(archive, tables, kind).filter("failed > 0").count() + (not whole)
        return publish(spark, staged, target, failed, kind)


#: `archive` is the folder of the version's archive, where it is not in `path`.
CATALOGUE = "version long, path string, kind string, archive string"


def versions(spark: SparkSession, target: str) -> list:
    """The published versions, the newest first; none where nothing was published."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CATALOGUE).parquet(f"{target}/catalogue").orderBy(F.desc("version")).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def publish(spark: SparkSession, staged: str, target: str, failed: int, kind: str = "two", archive: str | None = None) -> dict[str, DataFrame]:
    """Point the catalogue at the staged version once its checks are clean; readers of the old version keep it. One writer a
    dataset: versions are numbered by those that are there."""
    if failed:
        raise ValueError(f"{failed} checks failed; {target} is as it was")
    last = versions(spark, target)
    row = ((last[0]["version"] if last else 0) + 1, staged, kind, archive)
    spark.createDataFrame([row], CATALOGUE).write.mode("append").parquet(f"{target}/catalogue")
    return current(spark, target)


def current(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    newest = versions(spark, target)[0]
    path, kind = newest["path"], newest["kind"]
    return {"archive": bucketed(spark, newest["archive"] or _archive_path(spark, path), kind)} | {n: spark.read.parquet(f"{path}/{n}") for n in RECIPES[kind]}


def _archive_path(spark: SparkSession, version: str) -> str:
    """The one folder of a version that is named archive-by-<buckets>."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{version}/archive-by-*")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)[0].getPath().toString()


def rebuild(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """Derive every table again from the published archive alone, and publish. The new version shares the archive, whose files never
    change, with the one before: a version's folder must stay as long as a later one names its archive."""
    newest = versions(spark, target)[0]
    kind, place = newest["kind"], newest["archive"] or _archive_path(spark, newest["path"])
    archive, staged = bucketed(spark, place, kind), f"{target}/staged-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        tables = derive(archive, staged, kind)
        return publish(spark, staged, target, ck.failures(archive, tables, kind).filter("failed > 0").count(), kind, place)


def drop_derived(spark: SparkSession, target: str) -> None:
    """Removes the derived tables of every published version. Archives stay, so that `rebuild` makes the tables again; until
    then the dataset has none."""
    for version in versions(spark, target):
        for name in RECIPES[version["kind"]]:
            deleted(spark, f"{version['path']}/{name}")


def csv_to_parquet(spark: SparkSession, source: str, target: str, kind: str) -> DataFrame:
    read_hits_csv(spark, source, kind).write.option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def catalogue(hits: DataFrame, events: DataFrame) -> DataFrame:
    """One row on a dataset: counts, kinematic bounds, lattice values."""
    h = hits.agg(F.count("*").alias("n_hits"), F.sum("energy").alias("energy"), *[F.array_sort(F.collect_set(a)).alias(f"{a}_values") for a in "xyz"])
    e = events.agg(F.count("*").alias("n_events"), F.min("e1").alias("min_e1"), F.max("e1").alias("max_e1"), F.max("d").alias("max_d"))
    return h.crossJoin(e).withColumns({f"n_{a}": F.size(f"{a}_values") for a in "xyz"})
