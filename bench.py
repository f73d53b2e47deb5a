"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS set the tables and the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadpulse.checks.queries import QUERIES  # noqa: E402
from roadpulse.session import build_session  # noqa: E402

HEADLINE = [
    "assign_nearest",
    "assign_fuzzy",
    "count_updates_fuzzy",
    "seed_sample",
    "greedy_cluster",
    "greedy_cluster_rounds",
    "greedy_cluster_bucketed",
    "merge_state",
    "update_sd",
    "rank_quantiles_fitness",
    "step_crisp",
    "step_fuzzy",
    "replay_crisp",
    "replay_fuzzy",
    "stream_replay",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the workers and load the tables' footers before the clock runs.
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.range(8).groupBy("id").applyInPandas(lambda pdf: pdf, "id long").count()
    seconds = {}
    for name in names:
        began = time.monotonic()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
