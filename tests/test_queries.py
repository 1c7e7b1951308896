"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from recollect.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    told = duck.sql(catalogue.ORACLE_SQL[name])
    assert columns == sorted(told.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {listed} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert rows == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
