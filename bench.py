"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. Each query runs once unmeasured, then the best of three counts.

``generated_*`` count the groups of 60 M generated rows (2.4 M pages of 25) with the key column cached, by number of groups: as many rows
as the smallest logged runs of the baseline have. They are listed beside the others and not part of the total, which stays comparable
between rounds. BENCH_GENERATED_PAGES sets the pages; 0 leaves them out.
"""

import json
import os
import time

from gristmill.operators import cart
from gristmill.operators.aggregate import AggSpec, group_aggregate, raw_aggregate
from gristmill.operators.shuffle import discard
from gristmill.plans import registry
from gristmill.session import local_session
from gristmill.sources.generator import generated
from gristmill.sources.tables import table


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey").persist()
    lines.count()
    runs = {
        "group_count_few": lambda: discard(group_aggregate(lines, AggSpec(["l_returnflag"]))),
        "group_count_mid": lambda: discard(group_aggregate(lines, AggSpec(["l_suppkey"]))),
        "group_count_many": lambda: discard(group_aggregate(lines, AggSpec(["l_orderkey"]))),
        "raw_count_many": lambda: discard(raw_aggregate(lines, AggSpec(["l_orderkey"]))),
        "cart_count_many": lambda: discard(cart.adaptive_aggregate(lines, AggSpec(["l_orderkey"]))),
    }
    for q in ("group_count", "hll_estimate", "radix_partition_profile", "adaptive_group_count", "shuffle_rows"):
        runs[q] = lambda q=q: discard(registry.QUERIES[q](spark, folder))
    seconds = {}
    for name, run in runs.items():
        run()
        took = []
        for _ in range(3):
            began = time.perf_counter()
            run()
            took.append(time.perf_counter() - began)
        seconds[name] = round(min(took), 4)
    total = sum(seconds.values())
    lines.unpersist()
    pages = int(os.environ.get("BENCH_GENERATED_PAGES", "2400000"))
    for groups in (10, 1_000, 100_000, 10_000_000) if pages else ():
        keys = generated(spark, pages, groups, 1).select("c0").persist()
        keys.count()
        took = []
        for _ in range(3):
            began = time.perf_counter()
            discard(group_aggregate(keys, AggSpec(["c0"])))
            took.append(time.perf_counter() - began)
        seconds[f"generated_{groups}"] = round(min(took), 4)
        keys.unpersist(blocking=True)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(total, 4), "unit": "sec", "queries": seconds, "sf": folder.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
