"""Every registered query with SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from docledger import plans

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat()[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, str(SMALL))
    want = duck.sql(plans.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    key = lambda r: [(x is None, str(x)) for x in r]
    a = sorted(([plain(r[c]) for c in sorted(got.columns)] for r in got.collect()), key=key)
    b = sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=key)
    assert a == b


def test_registry():
    known = __spark_entry__.queries()
    assert set(plans.QUERIES) <= set(known)
    assert set(__spark_entry__.oracle_sql()) <= set(known)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
