"""Every query with oracle SQL gives the oracle's rows."""

import duckdb
import pytest

from tallyforge.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(row):
    return tuple(float(f"{float(v):.9g}") + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((norm(r) for r in df.select(*columns).collect()), key=str)
    if name not in SQL:
        assert got
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((norm([r[i] for i in at]) for r in want.fetchall()), key=str)


def test_interval_union_of_odd_dates(spark, tmp_path):
    con = duckdb.connect()
    rows = "(1, '1995-01-01'), (1, NULL), (1, NULL), (1, '1995-02-01'), (1, '1995-02-01'), (2, '1969-12-31 12:00:00'), (2, '1970-01-01'), (3, '2000-01-01 23:59:59.7'), (NULL, '2000-01-01'), (NULL, NULL)"
    con.sql(f"COPY (SELECT row_number() OVER () AS o_orderkey, k::BIGINT AS o_custkey, d::TIMESTAMP AS o_orderdate FROM (VALUES {rows}) v(k, d)) TO '{tmp_path}/orders.parquet'")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = QUERIES["interval_union"](spark, str(tmp_path)).select("o_custkey", "start", "end", "members").collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(SQL["interval_union"]).fetchall(), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
