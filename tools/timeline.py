"""Job and stage times of registered queries, from Spark's event log (no UI).

    python tools/timeline.py /root/testdata/sf0.1 load headline thin_margin_accounts

Runs the named queries (``load`` = the one-time line-item build) in a fresh
session whose event log goes to a new scratch folder, then prints, per
query, every job with its stages: duration, task count and the slowest task.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_events(log_dir: str):
    import zstandard

    for f in sorted(glob.glob(os.path.join(log_dir, "*", "events_*")) + glob.glob(os.path.join(log_dir, "events_*"))):
        raw = open(f, "rb")
        stream = zstandard.ZstdDecompressor().stream_reader(raw) if f.endswith(".zstd") else raw
        for line in io.TextIOWrapper(stream, encoding="utf-8"):
            try:
                yield json.loads(line)
            except ValueError:
                continue


def main():
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or ["load"]
    log_dir = tempfile.mkdtemp(prefix="run-events-", dir="/tmp")
    from marginscope import session

    session.DEFAULT_CONF.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    spark = session.get_spark("local[8]", 8)
    from marginscope.plans import QUERIES
    from marginscope.sources.table import line_items

    marks = []
    for n in names:
        t0 = time.time() * 1000
        if n == "load":
            line_items(spark, sf_dir)
        else:
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        marks.append((n, t0, time.time() * 1000))
    spark.stop()

    jobs, stages, tasks = {}, {}, {}
    for e in read_events(log_dir):
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = {"start": e["Submission Time"], "stages": [s["Stage ID"] for s in e["Stage Infos"]]}
        elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]]["end"] = e["Completion Time"]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Completion Time"] - si["Submission Time"], si["Number of Tasks"])
        elif ev == "SparkListenerTaskEnd":
            ti = e["Task Info"]
            sid = e["Stage ID"]
            tasks[sid] = max(tasks.get(sid, 0), ti["Finish Time"] - ti["Launch Time"])
    for n, t0, t1 in marks:
        mine = {j: v for j, v in jobs.items() if t0 <= v["start"] <= t1}
        busy = sum(v.get("end", v["start"]) - v["start"] for v in mine.values())
        print(f"{n}: {t1 - t0:.0f} ms wall, {len(mine)} jobs, {busy:.0f} ms inside jobs")
        for j, v in sorted(mine.items()):
            parts = []
            for s in v["stages"]:
                if s in stages:
                    d, k = stages[s]
                    parts.append(f"stage {s}: {d} ms / {k} tasks (slowest {tasks.get(s, 0)} ms)")
                else:
                    parts.append(f"stage {s}: skipped")
            print(f"  job {j} +{v['start'] - t0:.0f} ms: " + "; ".join(parts))


if __name__ == "__main__":
    main()
