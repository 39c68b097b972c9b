"""The registered queries against their DuckDB counterparts, on the smallest tables."""

import glob
import os

import pytest

from tessera.plans import catalog

duckdb = pytest.importorskip("duckdb")


def rows(table):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in table), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({catalog.oracles()[name]})").fetchall()
    assert rows(df.select(*cols).collect()) == rows(want)
    assert not [c for c, kind in df.dtypes if kind in ("int", "smallint")]


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_others_give_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).limit(1).count() == 1
