"""Seeded samples and shuffles.

Every row gets a random-looking key, the head of the md5 of its number and a
seed; equal keys are ordered by row number. A sample of n rows is "the n
smallest keys". The n-th smallest key is found first, by guessing or by counting
key prefixes, so the sample itself is a filter with two literals and neither a
sort nor a gather of the payload.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidforge.operators.identity import (
    BROADCAST_FILES,
    bucketed_position,
    file_starts,
    with_file_idx,
)

# Hex digits of a key, and digits fixed per counting pass: at most 4096 counts
# reach the driver.
KEY_DIGITS = 16
STEP_DIGITS = 3
# Keys sorted in one task once the cut has been narrowed.
LEAF_KEYS = 200_000
BROADCAST_BLOCKS = 1_000_000
# Up to this many blocks are looked up on the driver to name the files they lie in.
PRUNED_BLOCKS = 10_000
# Rows of one part of a shuffle.
PART_ROWS = 100_000


def shuffle_key(idx: str, *salt: int) -> Column:
    """Key of a row: md5 of its number and the salts, joined by hyphens."""
    text = f"concat_ws('-', cast(`{idx}` as string), {', '.join(repr(str(s)) for s in salt)})"
    return F.expr(f"substring(md5({text}), 1, {KEY_DIGITS})")


def _last_of_first(keys: DataFrame, n: int):
    """The n-th of ``keys`` in order, with how many there were up to n."""
    head = keys.orderBy("_key", "_id").limit(n)
    return head.agg(F.max(F.struct("_key", "_id")).alias("last"), F.count("*").alias("n")).first()


def key_cutoff(keys: DataFrame, n: int, rows: int) -> tuple[str, int]:
    """The n-th smallest of ``keys(_key, _id)``, a table of ``rows`` > ``n`` rows, in
    the order (key, id)."""
    if n <= LEAF_KEYS:
        # Keys are even, so a little more than n / rows of their range holds n.
        share = min(1.0, (n + 8 * math.sqrt(n) + 16) / rows)
        guess = f"{min(int(share * 16**KEY_DIGITS), 16**KEY_DIGITS - 1):0{KEY_DIGITS}x}"
        found = _last_of_first(keys.where(F.col("_key") <= guess), n)
        if found.n == n:
            return found.last["_key"], found.last["_id"]
    prefix, need = "", n
    while len(prefix) < KEY_DIGITS:
        part = keys.where(F.col("_key").startswith(prefix))
        head = F.substring("_key", 1, len(prefix) + STEP_DIGITS).alias("p")
        for row in part.groupBy(head).count().orderBy("p").collect():
            if need <= row["count"]:
                break
            need -= row["count"]
        prefix = row.p
        if row["count"] <= LEAF_KEYS:
            break
    found = _last_of_first(keys.where(F.col("_key").startswith(prefix)), need)
    return found.last["_key"], found.last["_id"]


def smallest_keys(df: DataFrame, key: Column, n: int, idx: str = "idx") -> DataFrame:
    """The ``n`` rows with the smallest keys (all rows if there are no more)."""
    if n <= 0:
        return df.limit(0)
    rows = df.count()
    if rows <= n:
        return df
    keyed = df.withColumn("_key", key)
    last_key, last_id = key_cutoff(keyed.select("_key", F.col(idx).alias("_id")), n, rows)
    below = f"_key < '{last_key}' or (_key = '{last_key}' and `{idx}` <= {last_id})"
    return keyed.where(below).drop("_key")


def row_sample(
    df: DataFrame, n: int, seed: int = 0, idx: str = "idx", ordered: bool = True
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, in row order if ``ordered``."""
    sample = smallest_keys(df, shuffle_key(idx, seed), n, idx)
    return sample.orderBy(idx) if ordered else sample


def pick_blocks(spark, rows: int, n: int, block_rows: int, seed: int) -> DataFrame:
    """``_block`` of ``ceil(n / block_rows)`` random whole blocks among ``rows`` rows.

    A partial block at the end counts only when it is the sole block.
    """
    total = max(rows // block_rows, 1)
    blocks = spark.range(total).withColumnRenamed("id", "_block")
    wanted = min(math.ceil(n / block_rows), total)
    return smallest_keys(blocks, shuffle_key("_block", seed), wanted, "_block")


def _rows_of_blocks(df: DataFrame, picks: DataFrame, n: int, block_rows: int, idx: str) -> DataFrame:
    """Rows of the picked blocks, cut to the first ``n``."""
    size = picks.agg(F.count("*").alias("blocks"), F.max("_block").alias("last")).first()
    tagged = df.withColumn("_block", F.expr(f"`{idx}` div {block_rows}"))
    small = size.blocks <= BROADCAST_BLOCKS
    chosen = tagged.join(F.broadcast(picks) if small else picks, "_block", "left_semi")
    surplus = size.blocks * block_rows - n
    if surplus > 0:
        # All picks before the last are whole blocks, so the cut falls there.
        keep = block_rows - surplus
        chosen = chosen.where(f"_block < {size.last} or `{idx}` - _block * {block_rows} < {keep}")
    return chosen.drop("_block").orderBy(idx)


def block_sample(
    df: DataFrame, n: int, block_rows: int = 100, seed: int = 2024, idx: str = "idx"
) -> DataFrame:
    """``ceil(n / block_rows)`` random blocks of consecutive rows, cut to ``n`` rows.

    ``idx`` must run 0..rows-1; the job that counts the rows stops otherwise. Picks are a
    few numbers, so rows are read by a semi join and only the sample is sorted.
    """
    place = F.col(idx).cast("decimal(20,0)")
    seen = df.agg(
        F.count("*").alias("rows"), F.min(idx).alias("low"), F.max(idx).alias("high"), F.sum(place).alias("total")
    ).first()
    rows = seen.rows
    if rows and (seen.low, seen.high, seen.total) != (0, rows - 1, rows * (rows - 1) // 2):
        raise ValueError(f"{idx} does not run 0..{rows - 1}; number the rows first")
    n = min(n, rows)
    if n <= 0:
        return df.limit(0)
    picks = pick_blocks(df.sparkSession, rows, n, block_rows, seed)
    return _rows_of_blocks(df, picks, n, block_rows, idx)


def block_sample_files(
    df: DataFrame, n: int, block_rows: int = 100, seed: int = 2024, idx: str = "idx"
) -> DataFrame:
    """:func:`block_sample` of a frame just read from files, numbered in file order.

    Only files that hold a picked block are opened.
    """
    starts_table = file_starts(df)
    size = starts_table.agg(F.sum("_rows").alias("rows"), F.count("*").alias("files")).first()
    rows = size.rows or 0
    n = min(n, rows)
    if n <= 0:
        return with_file_idx(df, idx).limit(0)
    picks = pick_blocks(df.sparkSession, rows, n, block_rows, seed)
    if size.files > BROADCAST_FILES or n / block_rows > PRUNED_BLOCKS:
        # So many blocks lie in most files anyway.
        return _rows_of_blocks(with_file_idx(df, idx), picks, n, block_rows, idx)
    files = sorted(tuple(r) for r in starts_table.select("_start", "_rows", "_file").collect())
    first = np.array([r["_block"] for r in picks.collect()], dtype=np.int64) * block_rows
    starts = np.array([r[0] for r in files], dtype=np.int64)
    low = np.searchsorted(starts, first, side="right") - 1
    # The last block is cut to the rows that are still wanted.
    end = first + block_rows
    end[first.argmax()] -= len(first) * block_rows - n if len(first) * block_rows > n else 0
    high = np.searchsorted(starts, np.minimum(end, rows) - 1, side="right") - 1
    needed = sorted({files[f][2] for a, b in zip(low, high) for f in range(a, b + 1)})
    numbered = with_file_idx(df, idx, only=needed)
    return _rows_of_blocks(numbered, picks, n, block_rows, idx)


def shuffle_batches(
    df: DataFrame, epoch: int = 0, seed: int = 2024, batch: int = 512, idx: str = "idx"
) -> DataFrame:
    """Add ``position``, a permutation that depends on seed and epoch, and the
    ``batch`` of ``batch`` rows it falls in.

    Keys are spread evenly, so their leading digits cut the rows into parts of
    about ``PART_ROWS``.
    """
    digits = max(1, math.ceil(math.log(max(df.count() / PART_ROWS, 2), 16)))
    keyed = df.withColumn("_key", shuffle_key(idx, epoch, seed))
    part = F.substring("_key", 1, digits)
    placed = bucketed_position(keyed, ["_key", idx], part, "position")
    return placed.drop("_key").withColumn("batch", F.expr(f"position div {batch}"))
