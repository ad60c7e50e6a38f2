"""Every registered query: equi-joins only, no Python in the plan, and
aggregates and joins inside whole-stage codegen."""

import pytest

from conftest import SF_SMALL
from gridload.plans.queries import QUERIES
from plan_text import plan

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
FUSED = ("HashAggregate", "BroadcastHashJoin", "SortMergeJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_hygiene(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()  # the final adaptive plan shows the codegen stages
    text = plan(df, "formatted").split("== Initial Plan ==")[0]
    for op in FORBIDDEN:
        assert op not in text, f"{name}: {op} in plan"
    for line in text.splitlines():
        op = line.strip(" :+-|")
        if op.split(" ")[0] in FUSED:
            raise AssertionError(f"{name}: {op} outside whole-stage codegen")
