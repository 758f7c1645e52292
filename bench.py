"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
with local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion with a no-op sink (``write.format("noop")``,
so the whole plan executes without collecting rows to the driver): one
warm-up, then the median of ``$BENCH_REPS`` (default 3) timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlens.plans import registry  # noqa: E402
from marketlens.session import get_spark  # noqa: E402

HEADLINE = [
    "window_stats_5min", "window_stats_sliding_1h_15min", "latest_stats", "recent_per_symbol",
    "market_overview_a", "enrich", "live_indicators", "tick_change", "rules_on_indicators",
    "arbitrage_1day", "arbitrage_5s", "arbitrage_lineitem_365d", "evaluate_alerts",
    "first_trigger", "unify_trades", "parse_envelope",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="marketlens-bench",
                      shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g",
                             # small inputs: keep AQE from merging every shuffle
                             # partition of a stage into one task
                             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"})
    qs = registry.queries()
    times = {}
    for name in names:
        run = lambda: qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()
        ts = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run()
            ts.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(ts), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
