"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from massloom.plans import contract, contract_runs, contract_search, contract_spectra  # noqa: F401

SF = os.environ.get("MASSLOOM_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet{'/*' if os.path.isdir(f'{SF}/{t}.parquet') else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([names[k] for k in order], *(repr(plain(r[k])) for k in order)) for r in found)


@pytest.mark.parametrize("name", sorted(contract.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = contract.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(contract.ORACLE[name])
    assert got == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(contract.QUERIES) - set(contract.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert contract.QUERIES[name](spark, SF).columns


def test_entry_imports():
    import __spark_entry__

    assert set(contract.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
