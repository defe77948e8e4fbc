"""Summarise the physical plans of registered queries (exchanges, joins, scans).

    python tools/plan_summary.py [sf_dir] [name ...] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuspack.plans import catalog  # noqa: E402
from corpuspack.session import local_session  # noqa: E402

DEFAULT = ["bundle_stats", "pack_bundle", "write_bundle", "transform_all", "dir_rollup", "toggle_dirs",
           "throttle", "tree_order", "select_glob", "snapshot_diff"]


def summary(plan: str) -> list[str]:
    out = []
    for ln in plan.splitlines():
        s = ln.strip()
        if re.match(r"^\(\d+\) ", s):
            out.append(s)
        elif s.startswith(("Arguments: hashpartitioning", "Arguments: rangepartitioning", "Arguments: SinglePartition",
                           "Arguments: RoundRobinPartitioning", "PushedFilters", "ReadSchema", "Join type",
                           "Join condition", "Location")):
            out.append("    " + s[:200])
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or DEFAULT
    spark = local_session(8)
    print("# Physical plans of headline queries\n")
    print(f"Generated by `tools/plan_summary.py` at `{sf}` (local[8], AQE on; final adaptive plans).")
    print("Steps that write a table first (ordered positions, the throttle's jump tables, stored views)")
    print("run as their own jobs; the plan below then starts from a scan of that written table.\n")
    for n in names:
        df = catalog.REGISTRY[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()  # run once so the adaptive plan is final
        plan = df._jdf.queryExecution().executedPlan().toString()
        formatted = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        ex = plan.count("Exchange") - plan.count("ReusedExchange")
        joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)", plan)
        print(f"## {n}\n")
        print(f"exchanges: {ex}; joins: {', '.join(sorted(set(joins))) or 'none'}; "
              f"python steps: {len(re.findall(r'MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython', plan))}\n")
        print("```")
        print("\n".join(summary(formatted)))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
