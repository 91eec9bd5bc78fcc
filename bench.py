"""Time the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``python bench.py name ...`` times only the named queries. Every query is built and run in
full (all rows, all columns, written to the no-op sink); the time includes jobs a query runs
while it is built. One untimed small query starts the JVM and the Python workers first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from facetide.plans.queries import QUERIES  # noqa: E402
from facetide.session import build_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def run(spark, name: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    names = sys.argv[1:] or list(QUERIES)
    spark = build_session("bench", cores=CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("timeline_minute", "score_faces_labels"):
        run(spark, name)
    seconds = {}
    for name in names:
        seconds[name] = round(run(spark, name), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cores": CPUS,
                "spark": spark.version,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                "cached_input": False,
            }
        )
    )


if __name__ == "__main__":
    main()
