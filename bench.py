"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query is fully computed with the ``noop`` sink (no collect to the driver).
A warm-up query runs first and is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "assign_tick",            # C1
    "coalesce_detections",    # C4
    "classify_outcomes",      # C3
    "dedup_deliveries",       # C2
    "to_enu",                 # B1
    "gate_pairs",             # D1
    "assign_pairs",           # D2
    "kalman_filter",          # D3
    "track_lifecycle",        # D4
    "build_tracks",           # D5 (flagship, split into space-time regions)
    "build_tracks_1min",      # D5, one fold
    "build_tracks_6h",        # D5, one fold of dense ticks: the slowest query
    "replay_tracks",          # D6
    "stream_tracks",          # D7
    "read_adsb_states",       # A2
    "enrich_weather",         # C8
    "current_tracks",         # E4
    "source_health",          # F1
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from sensortracks.plans import QUERIES
    from sensortracks.session import get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    QUERIES["to_enu"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    timings = {}
    for name in only or HEADLINE:
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
    total = round(sum(timings.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "input_events": events,
        "events_per_sec": {name: round(events / t, 1) for name, t in timings.items() if t},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
