"""Row numbers and ranks without a single-task window.

A rank is built from two parts: a position inside a chunk of bounded size, and
the rows before that chunk. Only the second part looks at more than one chunk,
and it reads one number per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.session import materialize

# A chunk of this many rows is sorted in one task.
CHUNK_ROWS = 1 << 20
# Files whose starting offsets are broadcast (about 200 bytes each).
BROADCAST_FILES = 500_000


def file_starts(df: DataFrame) -> DataFrame:
    """Rows per data file and the rows in all files sorting before it.

    Needs file footers only. The running sum sees one row per file.
    """
    files = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def with_file_idx(df: DataFrame, idx: str = "idx", only: list[str] | None = None) -> DataFrame:
    """Number rows 0..n-1 in (file name, row) order, for a frame just read from files.

    The position inside a file comes from the reader, so no row is shuffled.
    ``only`` limits reading to some files; their rows keep their numbers.
    """
    starts = materialize(file_starts(df), "file-starts")
    if only is not None:
        df = df.where(F.col("_metadata.file_path").isin(only))
    small = starts.count() <= BROADCAST_FILES
    located = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    offsets = starts.select("_file", "_start")
    joined = located.join(F.broadcast(offsets) if small else offsets, "_file")
    return joined.withColumn(idx, F.expr("_start + _row")).drop("_file", "_row", "_start")


def take_first(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """The first ``n`` rows in (file name, row) order, -1 for all.

    Files past the n-th row are not opened.
    """
    if n == -1:
        return with_file_idx(df, idx)
    last = file_starts(df).where(F.col("_start") < n).agg(F.max("_file")).first()[0]
    if last is None:
        return with_file_idx(df, idx).limit(0)
    head = df.where(F.col("_metadata.file_path") <= last)
    return with_file_idx(head, idx).where(F.col(idx) < n)


def with_idx(df: DataFrame, order_cols: list[str], idx: str = "idx") -> DataFrame:
    """Number rows 0..n-1 in the order of ``order_cols``.

    Rows are range-partitioned and sorted; equal keys are spread by a hash of
    the row. The numbering inside partitions is written out before it is used,
    because a repeated range sampling could draw other borders.
    """
    keys = [F.col(c) for c in order_cols]
    spread = F.xxhash64(*[F.col(c) for c in df.columns])
    ordered = df.repartitionByRange(*keys, spread).sortWithinPartitions(*keys, spread)
    numbered = materialize(ordered.withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    part, local = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    # One row per shuffle partition.
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(idx, F.col("_start") + local)
        .drop("_mid", "_part", "_start")
    )


def rank_within(
    df: DataFrame,
    group_cols: list[str],
    order_col: str,
    rank: str = "rank",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """1-based position of each row among the rows of its group.

    Groups of at most ``chunk_rows`` rows are ranked by one window. A larger
    group is cut into chunks: ``order_col`` is a row number, so a chunk
    ``order_col div chunk_rows`` holds at most ``chunk_rows`` rows. The rows
    before each chunk are added afterwards. Rows are shuffled once either way,
    by (group, chunk).
    """
    sizes = df.groupBy(*group_cols).agg(F.count("*").alias("_rows"))
    # At most rows / chunk_rows groups.
    large = sizes.where(F.col("_rows") > chunk_rows).drop("_rows").withColumn("_large", F.lit(True))
    tagged = _join_null_safe(df, F.broadcast(large), group_cols, ["_large"]).withColumn(
        "_chunk", F.expr(f"if(_large, `{order_col}` div {chunk_rows}, 0L)")
    )
    local = W.partitionBy(*group_cols, "_chunk").orderBy(order_col)
    ranked = tagged.withColumn("_local", F.row_number().over(local))

    chunks = tagged.where("_large").groupBy(*group_cols, "_chunk").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(*group_cols).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = chunks.withColumn("_before", F.sum("_rows").over(before)).drop("_rows")
    placed = _join_null_safe(ranked, offsets, [*group_cols, "_chunk"], ["_before"])
    position = F.expr("cast(_local + coalesce(_before, 0) as int)")
    return placed.select(*df.columns, position.alias(rank))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], added: list[str]) -> DataFrame:
    """Left join where null keys match each other."""
    match = F.expr(" and ".join(f"l.`{c}` <=> r.`{c}`" for c in keys))
    columns = [F.col(f"l.`{c}`") for c in left.columns] + [F.col(f"r.`{c}`") for c in added]
    return left.alias("l").join(right.alias("r"), match, "left").select(*columns)


def bucketed_position(
    df: DataFrame, order: list[str], bucket: Column, position: str
) -> DataFrame:
    """0-based position of each row in the order of ``order``.

    ``bucket`` grows with the order and cuts the rows into many even parts.
    """
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    local = F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1
    return (
        tagged.withColumn("_local", local)
        .join(starts, "_bucket")
        .withColumn(position, (F.col("_start") + F.col("_local")).cast("bigint"))
        .drop("_bucket", "_local", "_start")
    )
