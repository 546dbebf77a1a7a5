"""Checks on executed plans: what is filtered below what is scored."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def executed_plan(df: DataFrame) -> str:
    """The physical plan as text, one operator a line, indented by depth."""
    return df._jdf.queryExecution().executedPlan().toString()


def depth_of(plan: str, pattern: str) -> int | None:
    """Depth of the lowest operator that matches; deeper runs earlier."""
    found = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in plan.splitlines() if re.search(pattern, line)]
    return max(found) if found else None


def filters_below(df: DataFrame, filtered: str, scored: str) -> bool:
    """Whether a filter that matches ``filtered`` runs below every operator that matches ``scored``."""
    plan = executed_plan(df)
    low, high = depth_of(plan, filtered), depth_of(plan, scored)
    return low is not None and (high is None or low > high)
