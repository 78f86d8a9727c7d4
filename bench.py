"""Benchmark: the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line: ``{"metric": ..., "value": total_sec, "unit": "sec",
"queries": {name: sec}, "sf": ..., "lines": n, "lines_per_sec": ...}``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loghound.plans import queries as Q  # noqa: E402
from loghound.session import build_session  # noqa: E402

HEADLINE = ["high_frequency", "client_errors", "sql_injection", "shell_injection", "traversal",
            "error_rules", "verdicts", "threat_summary"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("loghound-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times = {}
    t0 = time.time()
    parsed = Q.parsed(spark, sf_dir)
    times["ingest_parse"] = round(time.time() - t0, 3)
    n_lines = parsed.count()
    t0 = time.time()
    Q._dets(spark, sf_dir)
    times["line_detections"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        t0 = time.time()
        Q.QUERIES[name](spark, sf_dir).collect()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "core_profile_total", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
                      "lines": n_lines, "lines_per_sec": round(n_lines / total, 1) if total else None}))
    spark.stop()


if __name__ == "__main__":
    main()
