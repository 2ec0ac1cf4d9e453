"""Every query that has SQL against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tidewright import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(0.0 if row[i] == 0 and isinstance(row[i], float) else row[i] for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    found = registry.queries()[name](spark, SF)
    expected = con.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in expected.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, expected.fetchall())
