"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cells(rows):
    """Rows as sorted texts; floats to nine significant digits, so that sums in another order compare alike."""
    return sorted(repr([f"{v:.9g}" if isinstance(v, float) else v for v in row]) for row in rows)


from rostra.plans import catalog  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, SF)
    result = tables.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert cells(df.select(*sorted(columns)).collect()) == cells([[row[columns.index(c)] for c in sorted(columns)] for row in result.fetchall()])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
