"""Queries that SQL can express, against DuckDB on the same tables."""

import pytest

from sparklog.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = con.execute(queries.SQL[name])
    names = [c[0] for c in got.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(got.fetchall())
    kinds = {"BIGINT": "bigint", "VARCHAR": "string"}
    assert {c[0]: kinds[str(c[1])] for c in got.description} == dict(df.dtypes)
