"""

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.  After one warm-up round
over all queries, each figure is the median of 5 timed runs after one more
warm-up of that query, including the parquet read, written to the ``noop``
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from rillet import operators as op  # noqa: E402
from rillet.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def t(spark, name):
    return spark.read.parquet(os.path.join(SF_DIR, f"{name}.parquet"))


def q_p3_filter(spark):
    return op.filter_rows(t(spark, "lineitem"), "l_quantity > 25")


def q_j1_join(spark):
    cust = t(spark, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return op.join(t(spark, "orders"), cust, "o_custkey", "inner")


def q_a1_sum(spark):
    return op.aggregate(t(spark, "lineitem"), "l_returnflag, l_linestatus", "l_quantity", "sum")


def q_p5_dedupe(spark):
    return op.deduplicate(t(spark, "lineitem"), "l_partkey, l_suppkey")


def q_a7_pivot(spark):
    return op.pivot(t(spark, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey", "count")


def q_w2_row_number(spark):
    return op.window_function(t(spark, "lineitem"), "row_number", "l_orderkey", order_by=["l_linenumber"])


QUERIES = {
    "P3_filter": q_p3_filter,
    "J1_join": q_j1_join,
    "A1_sum": q_a1_sum,
    "P5_dedupe": q_p5_dedupe,
    "A7_pivot": q_a7_pivot,
    "W2_row_number": q_w2_row_number,
}


def others():
    """Registered queries timed beside the headline ones (the training-data ones if they are there)."""
    from rillet.catalog import QUERIES as steps

    names = {"J8_fuzzy_match": steps, "R1_split_records": steps, "M6_running_balance": steps, "M2_quota_check": steps}
    try:
        from rillet.llm.queries import QUERIES as llm

        names |= {"op3_exact_dedup": llm, "op13_lexical_search": llm}
    except ImportError:
        pass
    return {k: (lambda spark, f=v[k]: f(spark, SF_DIR)) for k, v in names.items() if k in v}


def timed(spark, fn) -> float:
    start = time.perf_counter()
    fn(spark).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    extra = {}
    if os.environ.get("BENCH_EVENT_LOG_DIR"):  # stage / task times without the web UI
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG_DIR"]}
    spark = local_session(cores=CPUS, shuffle_partitions=CPUS, app="rillet-bench",
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "8g"), extra=extra)
    for fn in QUERIES.values():  # warm-up round: JIT and file metadata for every query
        timed(spark, fn)
    results = {}
    for name, fn in QUERIES.items():
        timed(spark, fn)
        results[name] = round(statistics.median(timed(spark, fn) for _ in range(RUNS)), 4)
    total = round(sum(results.values()), 4)
    for name, fn in others().items():
        timed(spark, fn)
        results[name] = round(statistics.median(timed(spark, fn) for _ in range(min(RUNS, 3))), 4)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": total,
                      "unit": "sec", "queries": results, "sf": sf, "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
