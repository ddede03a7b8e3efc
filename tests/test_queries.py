"""Every catalogued query against DuckDB on the smallest tables."""

import datetime

import duckdb
import pytest

from quillgraph.queries import ORACLES, QUERIES, _dealt_rows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


#: Queries that the smallest tables have no rows for.
MAY_BE_EMPTY = {"having"}


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    r = duck.sql(ORACLES[name])
    rows = [dict(zip(r.columns, x)) for x in r.fetchall()]
    assert rows or name in MAY_BE_EMPTY, "nothing to compare"
    assert sorted(df.columns) == sorted(r.columns)
    assert got == sorted((tuple(plain(x[c]) for c in sorted(x)) for x in rows), key=str)


def test_flagship_plan_prunes_and_pushes(spark, sf):
    text = QUERIES["flagship"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in text
    assert "o_orderpriority" not in text and "c_mktsegment" not in text
    assert text.count("orders.parquet") == 1  # the foreign key's own table is met once


def test_distribute_by_gives_every_row(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    got = QUERIES["distribute_by"](spark, sf)
    assert got.count() == orders.count() and got.columns == [*orders.columns, "parted"] and not got.where("parted").count()
    assert _dealt_rows(orders.repartition(3), "o_custkey").where("parted").count()
