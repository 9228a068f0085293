"""Queries with oracle SQL give the oracle's rows."""

import duckdb
import pytest

from tallyforge.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def norm(row):
    return tuple(float(f"{float(v):.9g}") + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert len(at) == len(want.columns)
    assert sorted((norm(r) for r in df.select(*columns).collect()), key=str) == sorted((norm([r[i] for i in at]) for r in want.fetchall()), key=str)
