"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (the whole plan runs, nothing is
collected). One warm-up pass, then the best of $BENCH_REPEATS timed passes per query.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskspark.plans.queries import Q, SQL  # noqa: E402
from riskspark.session import build_session  # noqa: E402

# Model training is measured separately (it is dominated by iteration count, not data).
# Queries that write and read back several stores are dominated by their number of small jobs.
SKIP = {"train_compare", "feature_importance", "score_batch", "artifact_manifest", "io_roundtrip", "io_values",
        "stream_scores", "score_requests", "store_failover"}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    names = [n for n in Q if n in SQL and n not in SKIP] + [n for n in Q if n not in SQL and n not in SKIP]
    names = list(dict.fromkeys(names))
    # Warm-up: JIT, file listing caches.
    for n in ("risk_kpis", "score_summary", "rolling_mean"):
        run(Q[n](spark, sf_dir))
    times = {}
    for n in names:
        best = None
        for _ in range(repeats):
            t0 = time.perf_counter()
            run(Q[n](spark, sf_dir))
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
