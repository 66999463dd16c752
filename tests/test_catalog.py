"""Every query of the newer plans equals its SQL on the smallest tables."""

import duckdb
import pytest

from sedimenta.plans import derived, pages, records, scale

DATA = "/root/testdata/sf0.001"
QUERIES = {**derived.table(), **pages.table(), **records.table(), **scale.table()}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations", "orders", "part"):
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    query, sql = QUERIES[name]
    mine, other = query(spark, DATA), con.sql(sql)
    assert sorted(mine.columns) == sorted(other.columns)
    rows = [sorted(map(repr, (tuple(r) for r in x))) for x in (mine.select(*sorted(mine.columns)).collect(), other.select(*[duckdb.ColumnExpression(c) for c in sorted(other.columns)]).fetchall())]
    assert rows[0] == rows[1]
