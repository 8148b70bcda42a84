"""Summarise the physical plans of the registered queries (after a run, so
AQE's final plan is shown): exchanges, broadcasts, reused exchanges, window
group limits, scan schemas and pushed filters.  Writes PLANS.md.

usage: python tools/plan_report.py [sf_dir] [name ...]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from shoppulse.plans.catalog import load_all  # noqa: E402
from shoppulse.session import get_session  # noqa: E402


def summarise(plan: str) -> dict:
    plan = plan.split("== Initial Plan ==")[0]  # AQE prints final and initial plans
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|"
                                   r"Exchange SinglePartition", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "reused": plan.count("ReusedExchange"),
        "window_group_limit": plan.count("WindowGroupLimit"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "python": plan.count("MapInPandas") + plan.count("ArrowEvalPython") + plan.count("BatchEvalPython"),
        "scans": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))),
        "pushed": sorted(set(p for p in re.findall(r"PushedFilters: (\[[^\]]*\])", plan) if p != "[]")),
    }


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_session("local[8]", 16)
    reg = load_all()
    lines = ["# Physical plans of the SQL-checked queries",
             "",
             f"Generated by `tools/plan_report.py` on `{sf_dir}` after executing each query, so the AQE",
             "final plan is summarised (shuffles = hash/range/round-robin/single-partition exchanges).",
             "",
             "| query | shuffles | broadcasts | reused exch. | WindowGroupLimit | SMJ | BHJ | python | scan columns | pushed filters |",
             "|---|---|---|---|---|---|---|---|---|---|"]
    for name, (fn, sql) in reg.items():
        if (names and name not in names) or (not names and sql is None):
            continue
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        try:  # the noop write ran its own execution; collect the final adaptive plan too
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
        except Exception:  # noqa: BLE001
            pass
        s = summarise(plan)
        scans = "<br>".join(x.replace("struct<", "").rstrip(">")[:90] for x in s["scans"])
        pushed = "<br>".join(p[:80] for p in s["pushed"])
        lines.append(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['reused']} | {s['window_group_limit']} | "
                     f"{s['sort_merge_joins']} | {s['broadcast_joins']} | {s['python']} | {scans} | {pushed} |")
        print(name, s["shuffles"], s["broadcasts"], s["reused"], file=sys.stderr)
    with open("PLANS.md", "w") as f:
        f.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
