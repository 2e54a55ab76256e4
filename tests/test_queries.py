"""Every netlist query against its SQL twin at the smallest scale."""

import pytest

from compare import same, views
from netloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return views(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, tables, name):
    same(QUERIES[name](spark, SF), tables, ORACLES[name])


def test_entry_runs_without_other_parts(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
