"""The registered queries of the subpackage at the smallest scale."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from accessgraph.llm.queries import LLM_ORACLES, LLM_QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in LLM_QUERIES)
    assert numbers == list(range(1, 14))
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(LLM_ORACLES))
def test_query_equals_its_sql(spark, name):
    ok, note, _ = compare(spark, connect(SF), name, LLM_QUERIES[name], LLM_ORACLES[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", [n for n in LLM_QUERIES if n not in LLM_ORACLES])
def test_query_runs(spark, name):
    assert LLM_QUERIES[name](spark, SF).count() > 0
