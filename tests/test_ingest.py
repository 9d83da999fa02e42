"""Sources and ingest: what must be refused is refused, and a refused load leaves what was published."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from showerlake.operators import checks as ck
from showerlake.plans import tables as tb
from showerlake.sources import files as fs
from showerlake.sources.fixtures import Fixture, fixture


@pytest.fixture(scope="module")
def c(spark, sf_dir):
    return fixture(spark, sf_dir)


@pytest.fixture(scope="module")
def loaded(c):
    target = fs.scratch(c.spark, "dataset")
    return target, fs.ingest(c.spark, tb.as_parquet(c), target)


def written(df, name="source"):
    path = fs.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


@pytest.mark.parametrize("kind", ["two", "one", "features"])
def test_kinds(c, kind):
    target = fs.scratch(c.spark, "dataset")
    out = fs.ingest(c.spark, tb.as_parquet(c, kind), target, kind)
    assert set(out) == {"archive", *fs.RECIPES[kind]} and out["archive"].count() == tb.typed(c, kind).count()
    again = fs.rebuild(c.spark, target)
    assert {n: df.count() for n, df in again.items()} == {n: df.count() for n, df in out.items()}
    assert [v["version"] for v in fs.versions(c.spark, target)] == [2, 1]


def test_refused_sources(c, loaded):
    target, before = loaded
    rows = tb.typed(c)
    whole = rows.withColumn("ix", F.col("ix").cast("long"))
    for bad, error in (
        (rows.drop("energy"), ValueError), (rows.withColumn("energy", F.col("energy").cast("string")), TypeError),
        (whole.withColumn("ix", F.col("ix") + (1 << 40)), (ValueError, PySparkException)), (rows.withColumn("ix", F.lit(99)), ValueError), (rows.withColumn("energy", F.lit(float("nan"))), ValueError),
    ):
        path = written(bad)
        with pytest.raises(error):
            fs.audit_source(bad, "two") if error is TypeError else fs.ingest(c.spark, path, target)
        assert len(fs.versions(c.spark, target)) == 1 and fs.current(c.spark, target)["events"].count() == before["events"].count()


def test_csv_is_pinned(c, spark):
    path = fs.scratch(spark, "csv")
    columns = [f.name for f in fs.schema("two")]
    for text in (",".join(reversed(columns)) + "\n", ",".join(columns) + "\n" + ",".join(["word"] * len(columns)) + "\n"):
        spark.createDataFrame([(text.strip(),)], "t string").coalesce(1).write.mode("overwrite").text(path)
        with pytest.raises((PySparkException, Py4JJavaError)):
            fs.read_hits_csv(spark, path, "two").collect()


def test_append_refuses_overlap(c):
    rows = tb.typed(c)
    with pytest.raises(ValueError, match="offset of"):
        fs.append_part(rows, rows)
    with pytest.raises(ValueError, match="kinds"):
        fs.append_part(rows, rows.drop("ix"))
    assert fs.append_part(rows, rows.limit(0)).count() == rows.count()


def failed(archive, tables, kind="two"):
    return {r["check"] for r in ck.failures(archive, tables, kind).filter("failed > 0").collect()}


def test_each_check_fails(c, loaded):
    _, out = loaded
    archive = out["archive"]
    assert not failed(archive, out)
    least = out["events"].agg(F.min("event_number")).first()[0]
    worse = {
        "projection": {"projection": out["projection"].unionByName(out["projection"])}, "lattice": {"projection": out["projection"].withColumn("iz", F.lit(7))},
        "energy": {"projection": out["projection"].withColumn("energy", F.lit(float("inf")))}, "derived": {"layers": out["layers"].filter(F.col("event_number") != least)},
        "undefined_d": {"events": out["events"].withColumn("d", F.lit(None).cast("double"))}, "shape_sums": {"shape_sums": out["shape_sums"].withColumn("e", F.col("e") * 1.01)},
        "profiles": {"profiles": out["profiles"].filter(F.col("event_number") != least)},
    }
    for name, change in worse.items():
        assert name in failed(archive, out | change), name


def test_single_and_feature_checks_fail(c):
    one = tb.typed(c, "one").withColumn("p_bin", F.col("p_bin"))
    repeated = ck.check_single(one.unionByName(one)).first()
    assert repeated["repeated"] > 0 and ck.check_single(one.withColumn("p_bin", F.col("p_bin") + 1)).first()["off_bin"] > 0
    assert ck.check_single(one.withColumn("particle_type", F.lit(None).cast("string"))).first()["unknown"] > 0
    assert ck.check_single(one.withColumn("parent_type", F.lit("x"))).first()["parents"] > 0
    features = tb.typed(c, "features")
    assert not failed(features, {"events": features}, "features")
    assert failed(features, {"events": features.unionByName(features)}, "features") == {"rows", "repeated"}
    assert "labels" in failed(features, {"events": features.withColumn("label", 1 - F.col("label"))}, "features")
    assert ck.check_rows(one, one.limit(1)).first()["failed"] == 1
    assert ck.check_rows_contract(c.hits.withColumn("zl", F.col("zl") + 5)).first()["rotation"] > 4
    assert ck.check_rows_contract(c.hits.withColumn("seg_pred", F.lit(2.0))).first()["out_of_range"] > 0


def test_rebuild_shares_the_archive(c, tmp_path):
    """A rebuild writes derived tables alone; the archive of the version before serves the new one, and the next rebuild as well."""
    target = f"file://{tmp_path}/dataset"
    first = fs.ingest(c.spark, tb.as_parquet(c), target)
    for _ in range(2):
        again = fs.rebuild(c.spark, target)
        assert again["archive"].inputFiles() == first["archive"].inputFiles()
        for name in fs.RECIPES["two"]:
            assert set(again[name].inputFiles()).isdisjoint(first[name].inputFiles())
        assert again["archive"].count() == first["archive"].count()
        assert again["layers"].exceptAll(first["layers"]).count() == 0 == first["layers"].exceptAll(again["layers"]).count()
    assert [v["version"] for v in fs.versions(c.spark, target)] == [3, 2, 1]


def test_sources_of_an_ingest_are_not_kept(spark, sf_dir):
    c = Fixture(spark, sf_dir)
    for kind in ("two", "one"):
        assert tb.typed(c, kind).columns == fs.schema(kind).names
    assert not {"raw", "single"} & set(vars(c))  # both are kept once they are asked for
