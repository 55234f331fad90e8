"""Every query that has SQL against DuckDB on the same tables."""

import math
import os

import pytest

import __spark_entry__
from sparklog.plans import queries as catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(names), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    got = duck.execute(catalogue.SQL[name])
    want = plain(got.fetchall(), [c[0] for c in got.description])
    assert plain(df.collect(), df.columns) == want
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}
    assert {c[0]: kinds.get(str(c[1]), str(c[1])) for c in got.description} == {n: t for n, t in df.dtypes}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry_and_contract(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_batch_retrieve_asks_every_hundredth_row(spark, tmp_path):
    """More asking rows than one block holds, against brute force."""
    import numpy as np

    r = np.random.default_rng(6)
    ids = np.arange(0, 30_000, 50)
    vectors = r.normal(size=(len(ids), 6)).astype(np.float32)
    spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = {(int(i), int(ids[j]), k + 1) for i, u in zip(ids, unit) if i % 100 == 0 for k, j in enumerate(np.argsort(1 - unit @ u)[:3])}
    got = {(x.query_id, x.row_id, x.rank) for x in catalogue.QUERIES["batch_retrieve"](spark, str(tmp_path)).collect()}
    assert len(want) == 900 and got == want
