from __future__ import annotations

import pytest
from oracle import connect, same

import __spark_entry__ as entry
from hexlane.plans import registry

NAMES = sorted(registry.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf).toPandas(), connect(sf).execute(registry.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
