"""Every registered query of the message engine against DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from lettermill.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return list(value) if hasattr(value, "tolist") else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    rows = lambda it: sorted((tuple(str(plain(v)) for v in r) for r in it))
    assert rows(tuple(r) for r in found.select(*[f"`{c}`" for c in columns]).collect()) == rows(result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    found = QUERIES[name](spark, FOLDER)
    assert found.columns
    found.write.format("noop").mode("overwrite").save()


def test_filters_come_before_the_limit(spark):
    plan = QUERIES["search_filter_newest"](spark, FOLDER)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.index("TakeOrderedAndProject") < physical.index("Filter")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
