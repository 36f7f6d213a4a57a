"""Every query that has SQL against it, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from strata.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, tiny, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tiny}/{table}.parquet'")
    df, found = registry.queries()[name](spark, tiny), con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r) for r in found.select(*order).fetchall())


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 11))
