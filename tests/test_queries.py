import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tessera.plans import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(name, DATA / "sf0.001")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: (-r.dependents, r.file))


def test_named():
    assert set(entry.oracle_sql()) <= set(entry.queries())
