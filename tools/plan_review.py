"""Look for costly shapes in the physical plans of the lazy queries.

Prints queries whose plan has a cartesian product, a nested-loop join, or a
sort/window over a single partition of unlimited rows.
"""
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tidemark.plans.catalog import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

EAGER = ("ml_", "st_", "src_", "sink_")


def main() -> None:
    spark = build_session("plans", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.log.level": "ERROR",
                                                  "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    names = sys.argv[1:] or [n for n in QUERIES if not n.startswith(EAGER)]
    for name in names:
        text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        lines = text.splitlines()
        flags = [x for x in ("CartesianProduct", "BroadcastNestedLoopJoin") if x in text]
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                # what is gathered, and by what
                above = next((lines[j].strip(" :+-*()0123456789") for j in range(i - 1, -1, -1) if "Sort " not in lines[j]), "")
                below = lines[i + 1].strip(" :+-*()0123456789") if i + 1 < len(lines) else ""
                if not ("Aggregate" in above and "Aggregate" in below) and "Limit" not in below and "Limit" not in above:
                    flags.append(f"single[{above[:60]} <- {below[:60]}]")
        if flags:
            print("PLAN", name, sorted(set(flags)))
    print("PLAN reviewed", len(names))


if __name__ == "__main__":
    main()
