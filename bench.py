"""Time headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default
8) the local cores. Every query runs to the end through the no-op sink.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sidforge.plans.catalog import QUERIES  # noqa: E402
from sidforge.session import local_session  # noqa: E402

HEADLINES = [
    "scan_partition",
    "geohash_encode",
    "item_text",
    "embed_text",
    "sanitize_vectors",
    "contiguous_idx",
    "residual_quantize",
    "quantization_loss",
    "lloyd_step",
    "sinkhorn_assign",
    "collision_stats",
    "dedup_rank",
    "level_usage",
    "geo_collision",
    "dup_vectors_full",
    "row_sample",
    "block_sample",
    "epoch_shuffle",
    "pick_best_model",
    "learn_merges",
    "mem_sid",
    "final_table",
    "resolve_collisions",
    "stream_assign",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, "sidforge-bench", "16g")
    QUERIES["residual_quantize"](spark, sf_dir).count()  # starts the JVM and Python workers
    times = {}
    for name in only:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
