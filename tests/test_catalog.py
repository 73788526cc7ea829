import pytest

import __spark_entry__ as entry
from tests.compare import connection, rows_of
from tessellum.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_its_sql(name, spark, data, con):
    df = catalog.queries()[name](spark, data)
    got = rows_of(df.columns, df.collect())
    if name in SQL:
        want = con.sql(SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == rows_of(want.columns, want.fetchall())


def test_entry_has_rows(spark, data):
    assert entry.entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
