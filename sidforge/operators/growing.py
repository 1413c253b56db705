"""An index that grows batch by batch.

Items of a later batch rank behind all stored items with the same codes. What a batch needs from
the past is one number per code tuple that it holds: how many items had it before. Every
batch leaves its own counts; each SNAPSHOT_EVERY batches they are summed into a snapshot, so
few of them are ever read. A batch writes only its own folders: if it is run again, it finds the
same past and writes the same rows.

Batches are numbered from 0 in the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidforge.functions.tokens import code_columns
from sidforge.operators.identity import CHUNK_ROWS, rank_within
from sidforge.operators.skew import join_counted
from sidforge.session import discard, materialize

SNAPSHOT_EVERY = 16


def _counts_path(root: str, number: int) -> str:
    return f"{root}/counts/batch={number}"


def _snapshot_path(root: str, number: int) -> str:
    """Counts of all batches before ``number``."""
    return f"{root}/snapshots/before={number}"


def counts_before(spark: SparkSession, root: str, number: int, codes: list[str]) -> DataFrame:
    """``(codes, n)``: items of all batches before ``number``."""
    start = number // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in codes), T.StructField("n", T.LongType())])
    paths = [_snapshot_path(root, start)] if start else []
    paths += [_counts_path(root, i) for i in range(start, number)]
    if not paths:
        return spark.createDataFrame([], schema)
    parts = spark.read.schema(schema).parquet(*paths)
    return parts.groupBy(*codes).agg(F.sum("n").alias("n"))


def add_batch(codes: DataFrame, root: str, number: int, idx: str = "idx", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Write the rows of batch ``number`` (idx, code_0 ..) with their rank as one more code.

    Batches before it must have been added. Within a batch items rank by ``idx``.
    """
    spark = codes.sparkSession
    cols = code_columns(codes)
    rank = f"code_{len(cols)}"
    rows = materialize(codes.select(idx, *cols), "arrived")
    sizes = rows.groupBy(*cols).agg(F.count("*").alias("n"))
    sizes.write.mode("overwrite").parquet(_counts_path(root, number))
    own = spark.read.parquet(_counts_path(root, number))
    past = counts_before(spark, root, number, cols).withColumnRenamed("n", "_before")
    known = own.join(past, cols, "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    ranked = rank_within(rows, cols, idx, rank, chunk_rows)
    placed = join_counted(ranked, known, cols, "n")
    path = f"{root}/index/batch={number}"
    placed.select(idx, *cols, (F.col(rank) + F.col("_before")).cast("int").alias(rank)).write.mode("overwrite").parquet(path)
    discard(rows)
    after = number + 1
    if after % SNAPSHOT_EVERY == 0:
        # The snapshot takes this batch in as well.
        parts = counts_before(spark, root, number, cols).unionByName(own)
        total = parts.groupBy(*cols).agg(F.sum("n").alias("n"))
        total.write.mode("overwrite").parquet(_snapshot_path(root, after))
    return spark.read.parquet(path)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the index, with the ``batch`` they came in."""
    return spark.read.option("basePath", f"{root}/index").parquet(f"{root}/index/batch=*")
