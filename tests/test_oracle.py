"""Every registered query with SQL gives the same rows on the small tables."""

import pytest

import __spark_entry__ as registry
from verification.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    assert difference(spark, db, name, FOLDER) == ""


def test_every_oracle_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_has_rows(spark):
    result = registry.entry(spark)
    assert result.columns == ["feature", "iv", "n_bins"]
    assert result.count() == 13
