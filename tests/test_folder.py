"""The drop folder: half-written, bad and known files, and runs one after the other."""

import os
import shutil
import time

import pytest

from showerlake.plans import tables as tb
from showerlake.sources import files as fs
from showerlake.sources.fixtures import fixture
from showerlake.streaming import folder as fd


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """One file of each kind, by name."""
    out = {}
    c = fixture(spark, sf_dir)
    for kind in fs.KINDS:
        place = str(tmp_path_factory.mktemp(kind)) + "/rows"
        tb.typed(c, kind).filter("event_number < 400").coalesce(1).write.parquet(place)
        out[kind] = next(f"{place}/{f}" for f in os.listdir(place) if f.endswith(".parquet"))
    return out


class Drop:
    def __init__(self, spark, tmp):
        self.spark, self.at, self.root = spark, str(tmp / "drop"), "file://" + str(tmp / "datasets")
        os.mkdir(self.at)

    def put(self, source, name, age=100):
        path = f"{self.at}/{name}"
        if isinstance(source, bytes):
            with open(path, "wb") as f:
                f.write(source)
        else:
            shutil.copyfile(source, path)
        os.utime(path, (time.time() - age,) * 2)

    def run(self, settle=30):
        log = fd.ingest_datasets(self.spark, self.at, self.root, self.root + "-checkpoint", settle).collect()
        return {r["file"].rsplit("/", 1)[-1]: (r["dataset"], r["action"]) for r in log}

    def rows(self, name):
        return fs.current(self.spark, f"{self.root}/{name}")["archive"].count()


@pytest.fixture
def drop(spark, tmp_path):
    return Drop(spark, tmp_path)


def test_kinds_bad_files_and_second_run(drop, parts, spark):
    assert drop.run() == {}
    for i, (kind, path) in enumerate(parts.items()):
        drop.put(path, f"Run {kind}.parquet", 500 - i)
    drop.put(b"no parquet at all", "bad.parquet", 300)
    drop.put(b"a,b\n1,2\n", "other.csv", 290)
    drop.put(parts["one"], "2024.parquet", 280)
    drop.put(b"x", "notes.txt")
    want = {f"Run%20{k}.parquet": (f"run_{k}", "loaded") for k in parts} | {"bad.parquet": ("bad", "rejected"), "other.csv": ("other", "rejected"), "2024.parquet": (None, "invalid_name")}
    got = {n.replace(" ", "%20"): a for n, a in drop.run().items()}
    assert got == want
    assert drop.rows("run_one") == spark.read.parquet(parts["one"]).count()
    assert not fs.versions(spark, f"{drop.root}/bad")
    assert {n.replace(" ", "%20"): a for n, a in drop.run().items()} == want
    assert [v["version"] for v in fs.versions(spark, f"{drop.root}/run_two")] == [1]


def test_half_written_file_waits(drop, parts):
    whole = open(parts["one"], "rb").read()
    drop.put(parts["one"], "old.parquet", 200)
    drop.put(whole[: len(whole) // 2], "growing.parquet", 1)
    assert drop.run() == {"old.parquet": ("old", "loaded"), "growing.parquet": ("growing", "unsettled")}
    drop.put(whole, "growing.parquet", 1)
    assert drop.run()["growing.parquet"] == ("growing", "unsettled")
    drop.put(whole, "growing.parquet", 60)
    assert drop.run() == {"old.parquet": ("old", "loaded"), "growing.parquet": ("growing", "loaded")}
    assert drop.rows("growing") == drop.rows("old")


def test_existing_dataset_stays(drop, parts, spark):
    fs.ingest(spark, parts["one"], f"{drop.root}/known", "one")
    drop.put(parts["two"], "known.parquet")
    assert drop.run() == {"known.parquet": ("known", "exists")}
    assert [(v["version"], v["kind"]) for v in fs.versions(spark, f"{drop.root}/known")] == [(1, "one")]
