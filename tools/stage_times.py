"""Per-stage durations and task counts from a Spark event log (no web UI needed).

Usage: python tools/stage_times.py <event-log-dir-or-file> [last_n_stages]
"""

from __future__ import annotations

import glob
import json
import os
import sys


def _files(path: str):
    if os.path.isfile(path):
        return [path]
    return sorted(f for f in glob.glob(os.path.join(path, "**", "*"), recursive=True) if os.path.isfile(f))


def main():
    path = sys.argv[1]
    last = int(sys.argv[2]) if len(sys.argv) > 2 else 30
    stages = []
    for f in _files(path):
        if f.endswith((".zstd", ".zst")):
            import io

            import zstandard
            with open(f, "rb") as raw:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8").read()
        elif f.endswith(("appstatus", ".inprogress")) and os.path.getsize(f) == 0:
            continue
        else:
            with open(f, encoding="utf-8", errors="replace") as fh:
                text = fh.read()
        for line in text.splitlines():
            if not line.startswith("{"):
                continue
            ev = json.loads(line)
            if ev.get("Event") == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                dur = (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000
                stages.append((info["Stage ID"], info["Number of Tasks"], dur, info["Stage Name"][:60]))
    for sid, tasks, dur, name in stages[-last:]:
        print(f"stage {sid:5d} tasks={tasks:4d} {dur:7.3f}s  {name}")


if __name__ == "__main__":
    main()
