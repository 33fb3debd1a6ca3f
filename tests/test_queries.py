"""Every registered query against its SQL; those without SQL must run and give rows."""

import pytest
from oracle import connect, duck_rows, spark_rows

from pairloom.plans import load

REGISTRY = load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLES))
def test_matches_sql(spark, sf, con, name):
    assert spark_rows(REGISTRY.QUERIES[name](spark, sf)) == duck_rows(con, REGISTRY.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.ORACLES)))
def test_runs(spark, sf, name):
    assert REGISTRY.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scans_are_pruned_and_filters_pushed(spark, sf, capsys):
    REGISTRY.QUERIES["cohort_filters"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")][0]
    assert "In(l_returnflag" in pushed and "EqualTo(l_linestatus,O)" in pushed
    schema = [line for line in plan.splitlines() if line.startswith("ReadSchema")][0]
    assert "l_extendedprice" not in schema
