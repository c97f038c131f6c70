"""Every registered query against its reference SQL, row by row."""

import pytest

from workload import catalog
from workload.compare import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    ok, note = compare(spark, duck, sf, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert ok, note


def test_registry_is_consistent():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_unrolled_recursion_is_finished(spark, sf, duck):
    from workload.privacy import _RANDOM, _WIDEST

    assert duck.execute(_WIDEST + "SELECT count(*) FROM mondrian WHERE pid_100 IS NULL").fetchall() == [(0,)]
    assert duck.execute(_RANDOM + "SELECT count(*) FROM mondrian WHERE pid_100 IS NULL").fetchall() == [(0,)]
