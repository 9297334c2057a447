"""Every registered query against its DuckDB oracle on sf0.001 (strict:
plain str() of every value, columns sorted by name, rows order-insensitive)."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, strict_norm

SF = "/root/testdata/sf0.001"


def _digest(df):
    cols = sorted(df.columns)
    rows = sorted("|".join(strict_norm(r[c]) for c in cols) for _, r in df.iterrows())
    return cols, len(rows), hashlib.sha256("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = duck.execute(E.oracle_sql()[name]).df()
    assert _digest(got) == _digest(want)


def test_every_query_has_an_oracle():
    assert set(E.QUERIES) == set(E.ORACLES)
