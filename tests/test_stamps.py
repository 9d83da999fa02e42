"""Stamps of a table: what has changed is seen, whatever the order of rows and however they are parted."""

import pytest
from pyspark.sql import functions as F

from showerlake.operators import models as md

SCHEMA = "k long, a int, b string"
ROWS = [(i * 700, i % 5, None if i % 7 == 0 else f"t{i}") for i in range(40)] + [(-3, 1, "x"), (None, 2, "y"), (2**62, 1, ""), (700, 1, "again"), (700, 1, "again")]


def stamp(spark, rows, parts=3):
    return tuple(md.ordered_stamp(spark.createDataFrame(rows, SCHEMA).repartition(parts), "k").first())


def swap(rows, i, j, column):
    out = [list(r) for r in rows]
    out[i][column], out[j][column] = out[j][column], out[i][column]
    return [tuple(r) for r in out]


def test_layout_is_no_change(spark):
    assert stamp(spark, ROWS) == stamp(spark, ROWS[::-1], 7) and stamp(spark, ROWS)[0] == len(ROWS)


@pytest.mark.parametrize("changed", [
    swap(ROWS, 1, 2, 1), swap(ROWS, 3, 4, 2), swap(ROWS, 5, 6, 0), ROWS[:-1], ROWS + [ROWS[3]], [*ROWS[:-5], (-3, 1, None), *ROWS[-4:]],
    [(1 << 40, 0, "a"), *ROWS[1:]], [(None if r[0] == 0 else r[0], *r[1:]) for r in ROWS],
])
def test_changes_are_seen(spark, changed):
    assert stamp(spark, changed) != stamp(spark, ROWS)


def test_values_do_not_run_together(spark):
    one, other = ([(1, x, y)] for x, y in ((1, "2:34"), (12, "34")))
    assert stamp(spark, one) != stamp(spark, other)


def test_empty(spark):
    assert stamp(spark, [])[0] == 0 and stamp(spark, []) != stamp(spark, ROWS)


def test_where(spark):
    old = spark.createDataFrame(ROWS, SCHEMA)
    new = old.filter("k IS NULL OR k <> -3").withColumn("a", F.when(F.col("k") == 1400, 9).otherwise(F.col("a"))).union(spark.createDataFrame([(50_000, 1, "new"), (None, 1, "n")], SCHEMA))
    got = {tuple(r) for r in md.changed_ranges(old, new, "k").collect()}
    assert got == {(-1024, -1, 1, 0), (1024, 2047, 1, 1), (49152, 50175, 0, 1), (None, None, 1, 2)}
    assert not md.changed_ranges(old, old.repartition(5), "k").collect()
