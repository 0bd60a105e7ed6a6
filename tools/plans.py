"""List plan facts of the registered queries: exchanges, nested-loop joins, single-partition exchanges, scan columns.

    python tools/plans.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import session  # noqa: E402

from tidebar.catalog import QUERIES  # noqa: E402


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = session()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    for name in args.names or QUERIES:
        plan = QUERIES[name](spark, args.sf)._jdf.queryExecution().explainString(mode)
        flags = [f for f in ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition", "BatchEvalPython") if f in plan]
        scans = sorted({m.count(":") for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan)})
        print(f"{name}: exchanges={plan.count('Exchange hashpartitioning')} windows={len(re.findall(r'- Window ', plan))} scan_columns={scans} {' '.join(flags)}", flush=True)


if __name__ == "__main__":
    main()
