"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from docloom import plans

DATA = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)), list(df.columns)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    assert rows(plans.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(plans.oracle_sql()[name]).df())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
