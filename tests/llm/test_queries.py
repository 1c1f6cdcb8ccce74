"""Every registered query of the subpackage over whole tables, against its SQL where there is one."""

from __future__ import annotations

import os

import duckdb
import pytest

from massloom.llm import queries

SF = os.environ.get("MASSLOOM_TEST_SF", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(queries.ORACLE[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in df.collect()]
    assert sorted(want[0]) == cols
    assert sorted(repr([r[c] for c in cols]) for r in got) == sorted(repr([r[c] for c in cols]) for r in want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_gives_a_row_for_each_document(spark, name):
    df = queries.QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert df.count() == docs.count() and df.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
