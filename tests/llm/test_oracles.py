"""Queries that SQL can express against their reference SQL, row by row."""

import pytest

from hushframe.llm.queries import ORACLES, QUERIES
from workload.compare import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    ok, note = compare(spark, connect(sf), sf, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_thirteen_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
