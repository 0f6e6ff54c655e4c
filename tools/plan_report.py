"""Write PLANS.md: the executed physical-plan shape of every registered query.

Runs each query over the stored domain tables of one scale factor (the warehouse form
the bench uses), executes it (so AQE has settled the final plan) and counts shuffles,
join strategies, windows and filters pushed into the parquet scans.
Usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from seatgrid.plans.catalog import ON_DOMAIN  # noqa: E402
from seatgrid.session import local_session, scratch_path  # noqa: E402
from seatgrid.sources.domain import Domain  # noqa: E402


def shape(plan: str) -> dict[str, int]:
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "windows": len(re.findall(r"\bWindow\b", plan)),
        "scans": plan.count("FileScan parquet"),
        "pushed": len(re.findall(r"PushedFilters: \[[^\]]+\]", plan)),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    d = Domain(spark, sf_dir).materialize(scratch_path(spark, "plan-report"))
    lines = ["| query | shuffles | broadcast exchanges | sort-merge joins | broadcast joins | windows | parquet scans | scans with pushed filters |",
             "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    for name, fn in ON_DOMAIN.items():
        if name.startswith("stream_"):
            continue  # streaming jobs run through foreachBatch sinks
        df = fn(d)
        df.write.format("noop").mode("overwrite").save()
        s = shape(df._jdf.queryExecution().executedPlan().toString())
        lines.append(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {s['smj']} | {s['bhj']} | {s['windows']} | "
                     f"{s['scans']} | {s['pushed']} |")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
