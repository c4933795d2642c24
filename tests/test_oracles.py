"""Every query that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 7) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_rows(name, spark, duck):
    df = driver.queries()[name](spark, SF_DIR)
    cursor = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want, got = plain(cursor.fetchall(), names), plain([tuple(r) for r in df.collect()], df.columns)
    assert len(want) == len(got)
    assert want == got


def test_every_own_query_has_sql():
    from sparkloom.plans import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.SQL)
