"""Every registered query with SQL against DuckDB, value for value."""
import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*(table.column(n).to_pylist() for n in names))))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_duckdb(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    want = duck.sql(catalog.SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_reaches_the_scan(spark):
    plan = catalog.QUERIES["hourly_by_type"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "props" not in plan.split("ReadSchema")[1]
