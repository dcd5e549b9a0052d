"""Joins inside the views: what grows is merged, not broadcast by the driver."""

from __future__ import annotations

import pytest

from accessgraph.plans.views import domain_tables, view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["v_places", "v_name_queries"])
def test_parts_are_merged(spark, name):
    rows = view(spark, SF, name)
    assert "strategy=merge" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMergeJoin" in rows._jdf.queryExecution().executedPlan().toString()


def test_places_of_a_record_read_no_broadcast_part(spark):
    """The small table of nations may be broadcast, the parts that places are named after may not."""
    plan = domain_tables(spark, SF)["places"].select("id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 1 and "SortMergeJoin" in plan
