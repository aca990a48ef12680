"""Time the headline queries: one JSON line with seconds per query, each the median of three runs after a warm-up.

BENCH_SF_DIR picks the data, BENCH_CPUS the cores, BENCH_QUERIES (comma separated, or ``all``) the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from proofline import plans, session  # noqa: E402

RUNS = 3
HEADLINE = ("d1_diff_tables", "d3_diff_summary", "q15_test_suite", "c2_audit_left_join", "g3_closure_down", "a7_payer_costs",
            "j14_deepest_prefix", "t6_stream_upsert", "m5_customers", "m6_orders", "m10_order_metrics", "j11_interval_overlap",
            "w1_sequence_key", "d16_line_delta", "c6_audit_constraints")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    plans.load()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(plans.QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_custkey").count()  # a query of its own
    joined.write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
