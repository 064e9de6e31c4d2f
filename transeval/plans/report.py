"""Physical-plan summary of every registered query (what runs, not how long).

    python -m transeval.plans.report --sf /root/testdata/sf0.1 > PLANS.md
"""

from __future__ import annotations

import argparse
import re
import sys
from collections import Counter

OPS = [("Exchange hashpartitioning", "hash exchange"), ("Exchange rangepartitioning", "range exchange"),
       ("Exchange SinglePartition", "single-partition exchange"), ("BroadcastExchange", "broadcast"),
       ("BroadcastHashJoin", "broadcast hash join"), ("SortMergeJoin", "sort-merge join"),
       ("ShuffledHashJoin", "shuffled hash join"), ("HashAggregate", "hash aggregate"),
       ("ObjectHashAggregate", "object hash aggregate"), ("SortAggregate", "sort aggregate"),
       ("Window", "window"), ("Generate", "generate"), ("ArrowEvalPython", "Arrow Python UDF"),
       ("MapInPandas", "mapInPandas"), ("Scan ExistingRDD", "checkpointed rows")]


def summarise(plan: str) -> tuple[dict, list[str]]:
    counts = Counter()
    for pat, label in OPS:
        counts[label] = len(re.findall(r"\b" + re.escape(pat) + r"\b", plan))
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
    return {k: v for k, v in counts.items() if v}, pushed


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    args = ap.parse_args(argv)
    sys.path.insert(0, ".")
    from transeval.plans.queries import QUERIES
    from transeval.session import checkpoint_dir, get_session
    spark = get_session(master="local[4]")
    checkpoint_dir(spark)
    print("# Physical plans of the registered queries\n")
    print(f"Final adaptive plans after one run at `{args.sf}` (local[4]); counts of operators.\n")
    print("| query | operators | pushed filters |\n|---|---|---|")
    for name, fn in sorted(QUERIES.items()):
        df = fn(spark, args.sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        ops, pushed = summarise(plan)
        ops_s = ", ".join(f"{v}× {k}" for k, v in ops.items()) or "projection only"
        print(f"| {name} | {ops_s} | {'; '.join(p for p in pushed if 'IsNotNull' not in p or ',' in p)[:120]} |")


if __name__ == "__main__":
    main()
