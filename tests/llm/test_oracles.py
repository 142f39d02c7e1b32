"""The training-data queries that SQL can express against DuckDB; all queries for names and key columns."""

import duckdb
import pytest

from tidewright.llm.catalog import REGISTRY
from tidewright.session import TABLES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_query(spark, con, name):
    df = REGISTRY.queries[name](spark, SF_DIR)
    known = con.sql(REGISTRY.sql[name])
    assert sorted(df.columns) == sorted(known.columns)
    order = sorted(df.columns)
    place = [known.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in known.fetchall())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY.queries) == list(range(1, 11))
