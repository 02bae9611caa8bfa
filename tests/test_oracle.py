"""Each query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__
from chronofold.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    def value(x):
        if isinstance(x, float | decimal.Decimal):
            return round(float(x), 6) + 0.0
        return x.isoformat() if isinstance(x, datetime.date) else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, db, name):
    out = queries.QUERIES[name](spark, SF)
    names = sorted(out.columns)
    found = db.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == names
    assert plain(out.select(names).collect()) == plain(found.select(*[f'"{n}"' for n in names]).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
