"""Every registered query against its SQL."""

import pytest
from comparing import DATA

from tallyweave import catalogue

catalogue.load()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.SQL[name], DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(name, spark):
    assert catalogue.QUERIES[name](spark, str(DATA / "sf0.001")).columns


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["i", "j"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
