"""Physical plans as they ran."""

from __future__ import annotations

import re


def final_plan(df) -> str:
    """The adaptive plan of ``df`` after it ran, without the plans it began with."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    kept, initial = [], None
    for line in plan.toString().splitlines():
        depth = re.search(r"[A-Za-z=(*]", line)
        depth = depth.start() if depth else 0
        if initial is not None and depth >= initial:
            continue
        initial = depth if "== Initial Plan ==" in line else None
        if initial is None:
            kept.append(line)
    return "\n".join(kept)


def scans(plan: str, holding: str) -> int:
    """File scans that read a column (or path) of that name."""
    return sum("FileScan" in line and holding in line for line in plan.splitlines())
