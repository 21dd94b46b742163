"""Every query against its SQL; queries without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# Empty by nature at this scale.
MAY_BE_EMPTY = {"outlier_slice", "top_findings", "best_resolution_orders"}
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    note = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert note == "" or (note == "EMPTY" and name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
