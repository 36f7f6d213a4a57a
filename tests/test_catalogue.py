"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from strata.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, tiny, con, name):
    df = catalogue.QUERIES[name](spark, tiny)
    found = con.sql(catalogue.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql(spark, tiny, name):
    assert catalogue.QUERIES[name](spark, tiny).count() > 0


@pytest.mark.parametrize("rows", [[], [(2, "b" * 9), (1, None), (2, "a"), (1, ""), (None, "é")], [(i // 3, f"{i} é" * (i % 977)) for i in range(3000)]])
def test_samples_of_joined_texts(spark, rows):
    """From the bytes that they hold, without a row of all texts."""
    out = catalogue._joined_samples(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    whole = "\n".join(t for _, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r))).encode()
    step = len(whole) // 16
    expected = whole if len(whole) <= 65536 else b"".join(whole[step * i : step * i + 4096] for i in range(16))
    assert [bytes(r["content"]) for r in out.collect()] == [expected]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
