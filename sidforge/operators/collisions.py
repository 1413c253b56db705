"""Items sharing a code tuple: counting, ranking, repair.

A bucket is a code tuple with its items. Counts are combined on the map side,
so a bucket holding a third of all rows is one number per task before the
shuffle. Members are only ever listed as rows, never gathered in one value.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidforge.functions.tokens import code_columns
from sidforge.operators import kernels as k
from sidforge.operators.balance import rows_per_task, sinkhorn_codes
from sidforge.operators.identity import CHUNK_ROWS, rank_within
from sidforge.operators.quantize import (
    assign_codes,
    fetch_levels,
    nearest_code,
)
from sidforge.operators.skew import join_counted
from sidforge.session import discard, materialize


def bucket_sizes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per distinct tuple, as ``n``."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def size_histogram(buckets: DataFrame) -> DataFrame:
    """Buckets per size. Distinct sizes number at most sqrt(2 * rows)."""
    return buckets.groupBy("n").agg(F.count("*").alias("buckets"))


def _summary():
    total = F.coalesce(F.sum(F.col("n") * F.col("buckets")), F.lit(0))
    unique = F.coalesce(F.sum("buckets"), F.lit(0))
    return [
        total.alias("total"),
        unique.alias("unique_sids"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_bucket"),
        F.coalesce(F.try_divide((total - unique).cast("double"), total), F.lit(0.0)).alias("rate"),
    ]


def collision_stats(df: DataFrame, code_cols: list[str] | None = None) -> DataFrame:
    """One row: items, distinct tuples, largest bucket, collision rate."""
    return size_histogram(bucket_sizes(df, code_cols or code_columns(df))).agg(*_summary())


def collision_rate(df: DataFrame, code_cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """One row: share of items beyond the first of their hyphen-joined code key.

    ``exact=False`` estimates the distinct keys with a sketch, for a quick look
    between fitting rounds.
    """
    keys = df.select(F.concat_ws("-", *(code_cols or code_columns(df))).alias("key"))
    distinct = F.count_distinct("key") if exact else F.approx_count_distinct("key", 0.01)
    return keys.agg(F.count("*").alias("total"), distinct.alias("unique_keys")).select(
        "total",
        "unique_keys",
        F.try_divide((F.col("total") - F.col("unique_keys")).cast("double"), "total").alias("rate"),
    )


def collision_groups(
    df: DataFrame, code_cols: list[str] | None = None, idx: str = "idx"
) -> DataFrame:
    """Members of every bucket with more than one item, one row per member.

    The list of a bucket is its rows ordered by ``idx``; a single array per
    bucket would have no size limit.
    """
    cols = code_cols or code_columns(df)
    shared = bucket_sizes(df, cols).where(F.col("n") > 1).withColumnRenamed("n", "group_size")
    return join_counted(df.select(idx, *cols), shared, cols, "group_size")


def dedup_rank(
    df: DataFrame,
    code_cols: list[str] | None = None,
    idx: str = "idx",
    rank: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Append one more code level: the position among items with equal codes."""
    cols = code_cols or code_columns(df)
    return rank_within(df, cols, idx, rank or f"code_{len(cols)}", chunk_rows)


def is_unique(df: DataFrame, code_cols: list[str] | None = None) -> DataFrame:
    """One row: whether every item has its own tuple."""
    return collision_stats(df, code_cols).select(
        (F.col("total") == F.col("unique_sids")).alias("collision_free")
    )


def resolve_collisions(
    df: DataFrame,
    codebook: DataFrame,
    rounds: int = 20,
    eps: float = 0.003,
    iters: int = 50,
    vec: str = "embedding",
    idx: str = "idx",
    task_rows: int | None = None,
) -> DataFrame:
    """Re-encode items that share codes, balancing the last level in each bucket.

    Every round treats each shared tuple as one balanced batch over the last
    level; earlier levels keep their nearest codes. Stops when all tuples differ,
    when a round changes nothing, or after ``rounds``. Identical vectors need
    not separate.

    An item never leaves its prefix (all codes but the last), so prefixes are
    independent. One with at most ``task_rows`` items runs all its rounds in one
    task; a larger one stays spread out, one job per round, and so do all prefixes when the
    last level is beyond the broadcast limit.
    """
    levels = codebook.agg(F.max("level")).first()[0] + 1
    prefix = [f"code_{i}" for i in range(levels - 1)]
    last = f"code_{levels - 1}"
    names = [*prefix, last]
    if levels > 1:
        left = assign_codes(df, codebook.where(F.col("level") < levels - 1), vec, [idx], residual=True)
    else:
        left = df.select(idx, F.col(vec).cast("array<double>").alias("residual"))
    # What the last level sees of an item never changes. The residual is kept
    # instead of its distances, which are as wide as the codebook.
    found = nearest_code(left, codebook, levels - 1, "residual")
    state = materialize(found.select(idx, *prefix, F.col("code").alias(last), "residual"), "codes")
    book = codebook.where(F.col("level") == levels - 1).withColumn("level", F.lit(0))
    words = fetch_levels(book)
    if words is None or not prefix:
        # A single level has one prefix, the whole table.
        return _repair_spread(state, book, names, rounds, eps, iters, idx, task_rows)
    words = words[0]
    task_rows = task_rows or rows_per_task(max(words.shape))

    shared = bucket_sizes(state, [*prefix, last]).groupBy(*prefix).agg(
        F.max("n").alias("_most"), F.sum("n").alias("_size")
    )
    # Prefixes without a shared tuple are done; the rest split by size.
    sized = materialize(shared.where("_most > 1"), "prefixes")
    small = sized.where(F.col("_size") <= task_rows).select(*prefix)
    large = sized.where(F.col("_size") > task_rows).select(*prefix)
    # At most rows / task_rows prefixes are large.
    big = F.broadcast(large)
    calm = state.join(big, prefix, "left_anti")
    quiet = calm.join(small, prefix, "left_anti").select(idx, *names)
    crowded = calm.join(small, prefix, "left_semi")
    inside = _repair_in_tasks(crowded, words, names, rounds, eps, iters, idx)
    result = quiet.unionByName(inside)
    if not large.isEmpty():
        huge = state.join(big, prefix, "left_semi")
        result = result.unionByName(
            _repair_spread(huge, book, names, rounds, eps, iters, idx, task_rows)
        )
    return result


def _repair_in_tasks(df, words, names, rounds, eps, iters, idx) -> DataFrame:
    """All rounds of a prefix inside one task."""
    *prefix, last = names
    schema = T.StructType([df.schema[c] for c in (idx, *names)])
    shipped = df.sparkSession.sparkContext.broadcast(words)

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by(idx)
        distances = k.distances(k.to_matrix(table.column("residual")), shipped.value)
        codes = k.separate(distances, table.column(last).to_numpy(), rounds, eps, iters)
        columns = {c: table.column(c) for c in (idx, *prefix)}
        return pa.table(columns | {last: pa.array(codes, pa.int32())})

    return df.groupBy(*prefix).applyInArrow(solve, schema)


def _repair_spread(df, book, names, rounds, eps, iters, idx, task_rows) -> DataFrame:
    """Rounds over prefixes too large for a task. Rows keep their residual, so a round
    shuffles the rows to their tuples and joins nothing back."""
    last = names[-1]
    columns = [idx, *names, "residual"]
    state, written = df.select(*columns), None
    for _ in range(rounds):
        shared = bucket_sizes(state, names).where("n > 1")
        marked = materialize(join_counted(state, shared, names, "n", "left").select(*columns, "n"), "marked")
        batch = F.concat_ws("-", *names).alias("batch")
        members = marked.where("n > 1").select(*columns, batch)
        moved = sinkhorn_codes(
            members, book, "batch", idx, "residual", 0, eps, iters, task_rows, columns[1:]
        )
        moved = moved.select(
            idx, *names[:-1], F.col("code").alias(last), "residual", (F.col("code") != F.col(last)).alias("_changed")
        )
        quiet = marked.where("n is null").select(*columns, F.lit(False).alias("_changed"))
        step = materialize(quiet.unionByName(moved), "codes", replaces=written)
        discard(marked)
        written, state = step, step.select(*columns)
        if step.where("_changed").isEmpty():
            break
    return state.select(idx, *names)
