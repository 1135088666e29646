"""Write PLANS.md: the physical plans of the headline queries (not part of pytest).

Usage: python tests/plan_report.py [sf_dir]

Each query is run once (so AQE's final plan is shown) and its plan is
printed with long expressions cut, followed by counts of shuffles,
broadcasts and join kinds.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

HEADLINE = {
    "audit_log": "flagship: narrow event keys, semi-joins on user ids, top 100 written once, lookups cut to those rows",
    "items_sold": ("lines grouped by order with no shuffle (bucketed on the order id); the completed orders are "
                   "small enough here for AQE to broadcast, and when they are not the join runs on the shared "
                   "buckets, also without a shuffle (see tests/test_plans.py)"),
    "daily_report": "one scan with eight pushed day ranges, one-pass conditional aggregation",
    "kitchen_tickets": "queue, lines cut to the queue by a semi-join, nested per order",
    "apply_order_status": "one aggregate per order over valid requests, joined back to orders",
    "sessionize_logins": "lead per (user, hour) plus a per-hour summary for the hour boundaries",
    "merge_cart_lines": "range-bounded windows, then a window over one row per range",
}


def trim(plan: str, width: int = 150) -> str:
    return "\n".join(line if len(line) <= width else line[:width] + " …" for line in plan.splitlines())


def counts(plan: str) -> str:
    def c(pattern):
        return len(re.findall(pattern, plan))
    return (f"shuffles {c(r'Exchange (hash|range|SinglePartition|RoundRobin)')}, "
            f"broadcasts {c(r'BroadcastExchange')}, broadcast joins {c(r'BroadcastHashJoin')}, "
            f"sort-merge joins {c(r'SortMergeJoin')}, windows {c(r'Window ')}, scans {c(r'FileScan|Scan ExistingRDD')}")


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    import __spark_entry__ as entry
    from tillroll.plans.inspect import plan_text
    from tillroll.session import build_session
    spark = build_session(shuffle_partitions=16)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `python tests/plan_report.py` on `{sf_dir}`, `local[8]`, 16 shuffle partitions, AQE on.",
           "Each query ran once before `explain`, so the plans are AQE's final plans (`isFinalPlan=true`);",
           "long expressions are cut with …. Table names `tillroll_<key>_<table>` are the stored, bucketed tables.", ""]
    for name, why in HEADLINE.items():
        df = entry.queries()[name](spark, sf_dir)
        df.collect()                      # runs df's own execution, so explain shows AQE's final plan
        plan = plan_text(df, "simple")
        plan = re.sub(r"file:/\S+?/tillroll-tables/\w+/", "<store>/", plan)
        plan = plan.split("+- == Initial Plan ==")[0]     # keep AQE's final plan only
        out += [f"## `{name}`", "", why + ".", "", counts(plan), "", "```", trim(plan).strip(), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
