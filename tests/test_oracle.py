"""Every query that SQL can express gives DuckDB's rows over the same tables."""

import duckdb
import pytest

from tidewright.plans.catalog import REGISTRY
from tidewright.session import TABLES


def cell(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(cell(r[i]) for i in order)) for r in data)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, con, sf_dir, name):
    df = REGISTRY.queries[name](spark, sf_dir)
    found = df.collect()
    if name not in REGISTRY.sql:
        assert found
        return
    known = con.sql(REGISTRY.sql[name])
    assert sorted(df.columns) == sorted(known.columns)
    assert rows(df.columns, found) == rows(known.columns, known.fetchall())
