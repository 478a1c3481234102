"""Every query of the catalogue that has SQL gives what DuckDB gives; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagemill.plans.catalogue import QUERIES, SQL

TABLES = "area_examples chat_rows doc_origins documents events lineitem mix_targets page_records raw_records size_limits task_specs".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(data, name)}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_parity(spark, data, db, name):
    df = QUERIES[name](spark, data)
    cursor = db.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    assert all(KINDS[k] == kinds[c] for c, k in df.dtypes if k in KINDS)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_epoch_order_is_whole(spark, tmp_path):
    spark.range(250).selectExpr("id AS doc_id", "'x' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["epoch_order"](spark, str(tmp_path)).collect()
    for epoch in (1, 2):
        mine = [r for r in got if r.epoch == epoch]
        assert sorted(r.pos for r in mine) == list(range(250)) == sorted(r.doc_id for r in mine)
    assert {r.doc_id: r.pos for r in got if r.epoch == 1} != {r.doc_id: r.pos for r in got if r.epoch == 2}


def test_contract():
    queries = entry.queries()
    assert set(QUERIES) <= set(queries) and set(entry.oracle_sql()) <= set(queries)
