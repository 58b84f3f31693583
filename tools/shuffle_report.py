"""Per-query stage, task and shuffle volumes from Spark's event log.

Runs every registered query on the given tables with the event log written to
a fresh scratch folder, tags each query's jobs with a job group, then reads the
log back: stages, tasks, shuffle bytes written and input bytes read per query.

    python tools/shuffle_report.py [/root/testdata/sf0.1]   # prints a Markdown table
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="courtline-eventlog-")
    from courtline.session import build_session
    from courtline import registry as entry
    spark = build_session("local[8]", 16, extra={"spark.eventLog.enabled": "true",
                                                  "spark.eventLog.dir": log_dir,
                                                  "spark.eventLog.compress": "false"})
    sc = spark.sparkContext
    names = list(entry.queries())
    for name in names:
        sc.setJobGroup(name, name)
        entry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("done", "done")
    spark.stop()

    stage_query: dict[int, str] = {}
    stats = defaultdict(lambda: {"stages": set(), "tasks": 0, "shuffle_write": 0, "input": 0})
    # Spark 4 writes rolling logs: a folder of event files per application
    paths = sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
                   if os.path.isfile(p) and "appstatus" not in os.path.basename(p))
    for path in paths:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        if group:
                            stage_query[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    q = stage_query.get(ev.get("Stage ID"))
                    if q is None:
                        continue
                    m = ev.get("Task Metrics") or {}
                    s = stats[q]
                    s["stages"].add(ev["Stage ID"])
                    s["tasks"] += 1
                    s["shuffle_write"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    s["input"] += (m.get("Input Metrics") or {}).get("Records Read", 0)
    print(f"Measured from the event log on `{sf_dir}` (local[8], 16 shuffle partitions, AQE on).\n")
    print("| query | stages | tasks | input rows | shuffle written MB |")
    print("| --- | --- | --- | --- | --- |")
    for name in names:
        s = stats[name]
        print(f"| {name} | {len(s['stages'])} | {s['tasks']} | {s['input']:,} | "
              f"{s['shuffle_write'] / 1e6:.2f} |")


if __name__ == "__main__":
    main()
