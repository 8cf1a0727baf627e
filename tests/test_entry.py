"""Every query with SQL against DuckDB on the smallest tables, and what the driver asks of the entry."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = [n for n in entry.oracle_sql() if not n.startswith(("p1_", "p2_", "p4_", "p7_", "p8_", "p9_", "p10_"))]


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "")
    return value


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert ours == theirs


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["import_batch_id", "speaker", "start_ms", "end_ms"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
