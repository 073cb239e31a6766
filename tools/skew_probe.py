"""Hot-key probe: one key holds a third of lineitem; show that no task holds the hot group.

Usage: python tools/skew_probe.py [sf_dir]
Prints, per step, the wall time and the largest / median task time of its stages
(from the event log in a fresh temp folder).
"""

from __future__ import annotations

import glob
import io
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import zstandard  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rillet import operators as op  # noqa: E402
from rillet.session import local_session  # noqa: E402


def task_times(log_dir: str) -> dict[int, list[float]]:
    out: dict[int, list[float]] = {}
    for f in glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True):
        with open(f, "rb") as raw:
            data = raw.read()
        text = (io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)), encoding="utf-8").read()
                if f.endswith(".zstd") else data.decode("utf-8", "replace"))
        for line in text.splitlines():
            if '"SparkListenerTaskEnd"' in line:
                ev = json.loads(line)
                info = ev["Task Info"]
                out.setdefault(ev["Stage ID"], []).append((info["Finish Time"] - info["Launch Time"]) / 1000)
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="skew-probe-")
    spark = local_session(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false"})
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # a third of the rows share key 0
    hot = li.withColumn("hk", F.when(F.col("l_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_orderkey")))
    n = li.count()
    steps = {
        "row_numbers (hot key split)": lambda: op.row_numbers(hot, "hk", ["l_linenumber"], output="rn",
                                                              max_group_rows=n // 10),
        "row_numbers (plain window)": lambda: op.row_numbers(hot, "hk", ["l_linenumber"], output="rn",
                                                             method="window"),
        "deduplicate": lambda: op.deduplicate(hot, "hk", ["l_linenumber"]),
        "aggregate": lambda: op.aggregate(hot, "hk", "l_quantity", "sum"),
        "join (hot key both sides)": lambda: op.join(
            hot.select("hk", "l_quantity"),
            hot.groupBy("hk").agg(F.count(F.lit(1)).alias("cnt")), "hk", "inner"),
    }
    print(f"rows={n}, hot key rows={hot.where('hk = 0').count()}")
    for fn in steps.values():  # warm-up: JIT, writers
        fn().write.format("noop").mode("overwrite").save()
    for name, fn in steps.items():
        before = {k for k in task_times(log_dir)}
        t = time.time()
        fn().write.format("noop").mode("overwrite").save()
        wall = time.time() - t
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = {k: v for k, v in task_times(log_dir).items() if k not in before}
        shuffled = [f"{max(v):.2f}/{statistics.median(v):.2f}s x{len(v)}"
                    for k, v in sorted(stages.items()) if len(v) >= 4]
        print(f"{name:30s} wall={wall:6.2f}s  stages with >= 4 tasks, largest/median task: {', '.join(shuffled)}")
    spark.stop()


if __name__ == "__main__":
    main()
