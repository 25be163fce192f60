"""Every registered query against its SQL on the smallest test tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from newsloom.plans import catalog, oracles

duckdb = pytest.importorskip("duckdb")
TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def comparable(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 9)
    return value


def sorted_rows(rows):
    return sorted((tuple(map(comparable, row)) for row in rows), key=lambda r: tuple(map(str, r)))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", catalog.queries())
def test_query_equals_its_sql(spark, database, name):
    frame = catalog.queries()[name](spark, str(TABLES))
    columns = sorted(frame.columns)
    cursor = database.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted_rows([row[i] for i in order] for row in cursor.fetchall())
    assert sorted_rows(frame.select(*columns).collect()) == expected


def test_no_query_joins_everything_with_everything(spark):
    for name, query in catalog.queries().items():
        plan = query(spark, str(TABLES))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
