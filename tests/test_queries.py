"""Every registered query against its SQL, on a small table; the others give rows."""

import duckdb
import pytest

from showerlake.plans import registry

TABLES = ("lineitem", "orders", "events", "documents")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def key(row):
    return tuple((x is None, str(type(x)), 0 if x is None else x) for x in row)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(r[columns.index(c)] for c in df.columns) for r in cur.fetchall()]
    assert sorted(got, key=key) == sorted(want, key=key)
