"""Helpers that read physical plans."""

import re


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_children(df) -> list[str]:
    """The operator directly below every ``Exchange SinglePartition`` of the plan."""
    lines = plan_text(df).splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            nxt = lines[i + 1] if i + 1 < len(lines) else ""
            out.append(re.sub(r"^[\s:+\-]*", "", nxt))
    return out


def assert_no_raw_rows_in_one_partition(df):
    """Rows may reach a single partition only after an aggregate or a bounded top-n."""
    for child in single_partition_children(df):
        assert child.startswith(("HashAggregate", "ObjectHashAggregate", "TakeOrderedAndProject",
                                 "SortAggregate")), child
