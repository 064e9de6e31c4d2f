"""Slowest stages of a run, read from Spark's event log (no UI needed).

    BENCH_EVENT_LOG_DIR=/tmp/run-x python bench.py
    python -m transeval.plans.stages /tmp/run-x [--top 15]
"""

from __future__ import annotations

import argparse
import glob
import io
import json
import os


def _lines(path: str):
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as f:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(f), encoding="utf-8", errors="replace")
    else:
        with open(path, encoding="utf-8", errors="replace") as f:
            yield from f


def stage_times(log_dir: str) -> list[dict]:
    files = sorted(glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True)) or \
        sorted(p for p in glob.glob(os.path.join(log_dir, "*")) if os.path.isfile(p))
    out = []
    for path in files:
        for line in _lines(path):
            if '"Event":"SparkListenerStageCompleted"' not in line:
                continue
            info = json.loads(line)["Stage Info"]
            out.append({"stage": info["Stage ID"], "tasks": info["Number of Tasks"],
                        "ms": info["Completion Time"] - info["Submission Time"], "name": info["Stage Name"]})
    return out


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("log_dir")
    ap.add_argument("--top", type=int, default=15)
    args = ap.parse_args(argv)
    rows = sorted(stage_times(args.log_dir), key=lambda r: -r["ms"])
    print(f"{len(rows)} stages, {sum(r['ms'] for r in rows) / 1000:.1f} s in total")
    for r in rows[:args.top]:
        print(f"{r['ms']:8d} ms  {r['tasks']:5d} tasks  stage {r['stage']:4d}  {r['name'][:70]}")


if __name__ == "__main__":
    main()
