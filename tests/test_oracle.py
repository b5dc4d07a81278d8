"""Every registered query with a SQL text against DuckDB, over whole tables."""

import pytest

from isoreach.registry import load
from tests.compare import connect, difference

ENTRIES = load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql is not None])
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    entry = ENTRIES[name]
    assert difference(entry.run(spark, sf_dir), duck, entry.sql) is None


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql is None])
def test_runs(name, spark, sf_dir):
    assert ENTRIES[name].run(spark, sf_dir).count() > 0
