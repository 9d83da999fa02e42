"""An ingest keeps on disk what it publishes: no shuffles of ended queries, no source made for it alone, no second set of tables."""

import os

import pytest

from showerlake.plans import tables as tb
from showerlake.sources import files as fs
from showerlake.sources.fixtures import fixture

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture(scope="module")
def c(spark, sf_dir):
    return fixture(spark, sf_dir)


def there(path):
    return os.path.exists(path.removeprefix("file://"))


def noted(monkeypatch, owner, name):
    """What each call of the function gave."""
    found, whole = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a, **b: (found.append(out := whole(*a, **b)), out)[1])
    return found


def test_a_source_goes_only_where_it_is_consumed(c):
    kept, gone = tb.as_parquet(c), tb.as_parquet(c)
    fs.ingest(c.spark, kept, fs.scratch(c.spark, "dataset"))
    out = fs.ingest(c.spark, gone, fs.scratch(c.spark, "dataset"), consume=True)
    assert there(kept) and not there(gone) and out["archive"].count() == tb.typed(c).count()


def test_a_refused_source_stays(c):
    path = fs.scratch(c.spark, "source")
    rows = tb.typed(c)
    rows.withColumn("ix", rows["ix"].cast("long") + (1 << 40)).write.parquet(path)
    with pytest.raises(Exception):  # noqa: B017  out of range, by the audit or by a cast
        fs.ingest(c.spark, path, fs.scratch(c.spark, "dataset"), consume=True)
    assert there(path)


def test_shuffles_go_during_ingest_and_rebuild(c, monkeypatch):
    seen, derive = [], fs.derive
    monkeypatch.setattr(fs, "derive", lambda *a, **b: (seen.append(c.spark.conf.get(CLEANUP)), derive(*a, **b))[1])
    was, target = c.spark.conf.get(CLEANUP), fs.scratch(c.spark, "dataset")
    fs.ingest(c.spark, tb.as_parquet(c), target)
    fs.rebuild(c.spark, target)
    assert seen == ["true", "true"] and c.spark.conf.get(CLEANUP) == was


def test_a_rebuild_needs_the_archive_alone(c, monkeypatch):
    derived = noted(monkeypatch, fs, "derive")
    again = tb.ingested(c, True)
    first, second = derived
    for name in fs.RECIPES["two"]:
        assert not any(there(f.replace("file:///", "/")) for f in first[name].inputFiles()) and all(there(f.replace("file:///", "/")) for f in second[name].inputFiles())
    kept = tb.ingested(c)
    for name in ("layers", "projection", "sample"):
        assert again[name].exceptAll(kept[name]).isEmpty() and kept[name].exceptAll(again[name]).isEmpty()


def test_published_tables_are_checked_against_their_own_source(c, monkeypatch):
    sources = noted(monkeypatch, tb, "as_parquet")
    assert [r["failed"] for r in tb.published(c).collect()] == [0] * 7 and len(sources) == 1
