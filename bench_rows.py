"""Rows per second of the main operators on tables that grow.

    python bench_rows.py [ROWS ...]     (default 200000 400000)

Vectors are those of BENCH_SF_DIR, repeated with a shift; a third of the codes are one tuple.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sidforge.operators import collisions, merges, quantize  # noqa: E402
from sidforge.plans import views  # noqa: E402
from sidforge.session import local_session, materialize  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "sidforge-rows", "16g")
    book = views.codebook(spark, sf_dir)
    few = materialize(views.vectors(spark, sf_dir), "vectors")
    base = few.count()
    for rows in [int(x) for x in sys.argv[1:]] or [200_000, 400_000]:
        copies = -(-rows // base)
        shifted = F.transform("embedding", lambda x: (x + F.col("copy") * F.lit(1e-6)).cast("float"))
        vectors = few.crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))
        vectors = vectors.select((F.col("idx") + F.col("copy") * base).alias("idx"), shifted.alias("embedding"))
        vectors = materialize(vectors.where(F.col("idx") < rows), "rows")
        hot = F.col("idx") % 3 == 0
        codes = quantize.assign_codes(vectors, book, keep=["idx"])
        codes = codes.withColumns({c: F.when(hot, F.lit(0)).otherwise(F.col(c)) for c in ("code_0", "code_1", "code_2")})
        codes = materialize(codes, "codes")
        tokens = codes.select(*(F.concat(F.lit(f"<{'abc'[i]}_"), f"code_{i}", F.lit(">")).alias(f"t{i}") for i in range(3)))
        jobs = {
            "assign_codes": lambda: quantize.assign_codes(vectors, book, keep=["idx"]),
            "dedup_rank": lambda: collisions.dedup_rank(codes),
            "collision_stats": lambda: collisions.collision_stats(codes),
            "learn_merges": lambda: merges.learn_merges(merges.seq_freq(tokens, tokens.columns))[1],
        }
        for name, job in jobs.items():
            started = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - started
            print(json.dumps({"operator": name, "rows": rows, "sec": round(spent, 2), "rows_per_sec": round(rows / spent)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
