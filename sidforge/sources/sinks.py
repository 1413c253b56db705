"""Writers. None of them narrows the write to a single task.

What is written is compared with what is read back: row count and the sum of the rows' hashes,
which does not depend on their order. The figures of the written rows are observed on their way
out; only the comparison reads the table again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sidforge.functions.tokens import code_columns

EMBEDDING_SCHEMA = "row_id string, item_id string, embedding array<float>"


def _fingerprint(columns: list[str]) -> list[Column]:
    """Row count and sum of row hashes; names in sorted order, since readers move columns."""
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(columns)))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hashed.cast("decimal(20,0)")), F.lit(0)).alias("total")]


def verify(table: DataFrame, columns: list[str], rows: int, total) -> None:
    """Raise unless ``table`` holds the rows that the figures describe."""
    found = table.agg(*_fingerprint(columns)).first()
    if (found.rows, found.total) != (rows, total):
        raise ValueError(f"wrote {rows} rows with hash sum {total}, read {found.rows} with {found.total}")


def write_verified(
    df: DataFrame, write: Callable[[DataFrame], None], read: Callable[[], DataFrame]
) -> DataFrame:
    """Write ``df`` and compare what ``read`` returns with the rows that went out."""
    seen = Observation()
    write(df.observe(seen, *_fingerprint(df.columns)))
    figures = seen.get
    table = read()
    verify(table, df.columns, figures["rows"], figures["total"])
    return table


def write_items(df: DataFrame, path: str) -> DataFrame:
    """Item table, one folder per country."""
    # A partition value is read as text, whatever it looks like.
    return write_verified(
        df.withColumn("country_code", F.col("country_code").cast("string")),
        lambda rows: rows.write.mode("overwrite").partitionBy("country_code").parquet(path),
        lambda: df.sparkSession.read.schema(df.schema).parquet(path),
    )


def write_embeddings(df: DataFrame, path: str) -> DataFrame:
    """Row id, item id and vector; earlier output is replaced."""
    table = df.select(
        F.col("row_id").cast("string").alias("row_id"),
        F.col("item_id").cast("string").alias("item_id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    return write_verified(
        table,
        lambda rows: rows.write.mode("overwrite").parquet(path),
        lambda: df.sparkSession.read.schema(EMBEDDING_SCHEMA).parquet(path),
    )


def write_index(df: DataFrame, path: str) -> DataFrame:
    """Row number and code tokens."""
    table = df.select(F.col("idx").cast("bigint").alias("idx"), *code_columns(df))
    return write_verified(
        table,
        lambda rows: rows.write.mode("overwrite").parquet(path),
        lambda: df.sparkSession.read.parquet(path),
    )


def write_index_json(df: DataFrame, path: str) -> DataFrame:
    """One JSON object per row: its number and its list of tokens."""
    table = df.select("idx", F.array(*code_columns(df)).alias("codes"))
    write_verified(
        table,
        lambda rows: rows.write.mode("overwrite").json(path),
        lambda: df.sparkSession.read.schema(table.schema).json(path),
    )
    return df.sparkSession.read.text(path)


def write_joined(df: DataFrame, path: str, expected: int) -> DataFrame:
    """Final table; raises unless exactly ``expected`` rows arrived."""
    seen = Observation()
    df.observe(seen, *_fingerprint(df.columns)).write.mode("overwrite").parquet(path)
    figures = seen.get
    written = df.sparkSession.read.parquet(path)
    verify(written, df.columns, figures["rows"], figures["total"])
    rows = figures["rows"]
    if rows != expected:
        raise ValueError(f"wrote {rows} rows, expected {expected}")
    return written
