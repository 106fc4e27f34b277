"""Every registered query runs; those that SQL can express equal it."""

import glob
import os

import duckdb
import pytest

from sparkloom.plans import registry

SQL = registry.oracle_sql()
ONLY_SPARK = sorted(set(registry.queries()) - set(SQL))


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def frame(df):
    df = df.reindex(sorted(df.columns), axis=1)

    def cell(v):
        if v is None or v != v:
            return None
        return round(v, 6) if isinstance(v, float) and v != int(v) else v if isinstance(v, (str, bool)) else float(v)

    return list(df.columns), sorted(repr([cell(v.item() if hasattr(v, "item") else v) for v in r]) for r in df.astype(object).where(df.notna(), None).to_numpy())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, con, name):
    assert frame(registry.queries()[name](spark, sf_dir).toPandas()) == frame(con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", ONLY_SPARK)
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() >= 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
