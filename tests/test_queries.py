"""Every registered query of the register work against its SQL, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from kinloom.plans import load, registry

SF_DIR = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

load()
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    """A value in a form that both engines share."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.isoformat()[:19] if hasattr(v, "isoformat") else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, str(SF_DIR))
    want = oracle.execute(registry.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert table(df.columns, df.collect()) == table(columns, want.fetchall())


def test_entry_gives_rows(spark):
    import __spark_entry__ as driver

    df = driver.entry(spark)
    assert df.columns and df.count() >= 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert all(isinstance(sql, str) for sql in driver.oracle_sql().values())
