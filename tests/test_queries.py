"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from lodestone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small_tables):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small_tables}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, small_tables, oracle, name):
    frame = registry.QUERIES[name](spark, small_tables)
    columns = sorted(frame.columns)
    got = Counter(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    cursor = oracle.execute(registry.SQL[name])
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == columns
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_gives_rows(spark, small_tables, name):
    assert registry.QUERIES[name](spark, small_tables).count() > 0
