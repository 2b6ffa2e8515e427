"""Every registered query with a SQL twin gives the same rows as the twin."""

import pytest

from tidemark.plans import catalogue
from tidemark.plans.check import compare


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, folder, name):
    assert compare(catalogue.QUERIES[name](spark, folder), catalogue.ORACLES[name], folder) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs_twice_alike(spark, folder, name):
    first = catalogue.QUERIES[name](spark, folder)
    rows = sorted(map(str, first.collect()))
    assert rows == sorted(map(str, catalogue.QUERIES[name](spark, folder).collect()))
