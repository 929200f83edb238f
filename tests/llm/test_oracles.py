"""Every query of this package that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from docledger.llm import registry
from tests.test_queries import SMALL, plain


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, name):
    c = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = registry.QUERIES[name](spark, str(SMALL)), c.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    a = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=key)
    b = sorted(([plain(r[want.columns.index(c)]) for c in columns] for r in want.fetchall()), key=key)
    assert a == b and a
