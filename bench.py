"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
number of local cores, BENCH_QUERIES (comma-separated) a choice of queries.
Every query runs over its whole tables and all its output columns are computed.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from isohyet import build_session  # noqa: E402
from isohyet.plans import registry  # noqa: E402

HEADLINES = [
    "hourly_clean", "daily_clean", "insert_ignore", "knn_join", "triangle_neighbors", "neighbor_features", "idw_grid",
    "local_lags", "forecast_features", "now_layer", "persistence_skill", "terrain_stats", "flatten_observations",
    "stream_hourly",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "isohyet-bench", f"local[{cpus}]",
        **{"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.hourly_rollup(spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM
    times = {}
    for name in names.split(",") if names else HEADLINES:
        start = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
