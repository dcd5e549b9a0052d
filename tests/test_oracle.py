"""Every registered query of the library against its SQL at the smallest scale."""

import pytest

from accessgraph.plans import catalogue  # noqa: F401
from accessgraph.plans.registry import ORACLES, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
# Iterative operators compared with brute force in test_space.py instead.
BRUTE_FORCE = {"i17_route_alternatives"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql_or_a_brute_force_test():
    assert set(QUERIES) - set(ORACLES) == BRUTE_FORCE


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query(spark, duck, name):
    ok, note, _ = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF)
    assert ok, note
