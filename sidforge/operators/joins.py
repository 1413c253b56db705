"""Joining codes, merge tokens and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.functions.text import stringified_sql
from sidforge.functions.tokens import code_columns, geo_sid
from sidforge.operators.skew import join_counted

# Columns of the final table, in order.
FINAL_FIELDS = [
    "item_id", "sence_id", "title", "description", "brand", "shop_id", "i_lng", "i_lag",
]


def join_audit(items: DataFrame, index: DataFrame, idx: str = "idx") -> DataFrame:
    """Row numbers that stop :func:`join_index`: found on one side only or repeated.

    One row per number and side, with the rows ``n`` it has there.
    """
    sides = items.select(idx, F.lit("items").alias("side")).unionByName(
        index.select(idx, F.lit("index").alias("side"))
    )
    # Counted before the shuffle; a null number meets nothing.
    counts = sides.groupBy(idx).agg(
        F.count_if(F.col("side") == "items").alias("_items"), F.count_if(F.col("side") == "index").alias("_index")
    )
    each = counts.select(
        idx,
        F.inline(
            F.array(
                F.struct(F.lit("items").alias("side"), F.col("_items").alias("n"), F.col("_index").alias("other")),
                F.struct(F.lit("index").alias("side"), F.col("_index").alias("n"), F.col("_items").alias("other")),
            )
        ),
    )
    lone = F.col(idx).isNull() | (F.col("other") == 0)
    return each.where((F.col("n") > 1) | ((F.col("n") > 0) & lone)).select(idx, "side", "n")


def join_index(
    items: DataFrame, index: DataFrame, idx: str = "idx", check: bool = True
) -> DataFrame:
    """Items beside their codes, one row for each row number.

    The job stops if a row lacks its partner or a row number repeats; both are seen in the
    shuffle of the join itself. ``check=False`` keeps just the rows that meet.
    """
    if not check:
        return items.join(index, idx)
    left, right = items.withColumn("_item", F.lit(True)), index.withColumn("_index", F.lit(True))
    met = left.join(right, idx, "full_outer")
    met = met.withColumn("_rows", F.count("*").over(W.partitionBy(idx)))
    wrong = (
        F.when(F.col("_index").isNull(), F.lit("unmatched row of items"))
        .when(F.col("_item").isNull(), F.lit("unmatched row of index"))
        .when(F.col("_rows") > 1, F.lit("repeated row number"))
    )
    stop = F.raise_error(F.concat(wrong, F.lit(": "), F.coalesce(F.col(idx).cast("string"), F.lit("null"))))
    fine = F.when(wrong.isNotNull(), stop.cast("boolean")).otherwise(F.lit(True))
    return met.where(fine).drop("_item", "_index", "_rows")


def with_geo_sid(df: DataFrame, code_cols: list[str] | None = None) -> DataFrame:
    """Add ``geo_sid``; a table without geohash gives ``<>`` before the SID."""
    place = "geohash" if "geohash" in df.columns else None
    return df.withColumn("geo_sid", geo_sid(place, code_cols or code_columns(df)))


def lookup_mem(df: DataFrame, seq_table: DataFrame, gen_cols: list[str]) -> DataFrame:
    """Add ``mem_sid`` of each row's gen sequence, empty when it has none.

    ``seq_table`` holds one row per distinct sequence with its number of items
    ``n``; a sequence that very many items share is not shuffled.
    """
    if len(gen_cols) < 2:
        return df.withColumn("mem_sid", F.lit(""))
    found = seq_table.select(*gen_cols, F.col("mem_sid").alias("_mem"), F.col("n").alias("_n"))
    return join_counted(df, found, gen_cols, "_n", "left").select(
        *df.columns, F.coalesce("_mem", F.lit("")).alias("mem_sid")
    )


def finalize(
    df: DataFrame, extra: list[str] | None = None, fill_nulls: bool = True, keep: list[str] | None = None
) -> DataFrame:
    """The final fields plus ``extra``; absent fields are empty.

    ``fill_nulls`` turns everything into text without nulls; otherwise values
    pass through unchanged.
    """

    def field(name: str) -> str:
        if name not in df.columns:
            return f"'' as {name}"
        return f"{stringified_sql(name)} as {name}" if fill_nulls else name

    wanted = FINAL_FIELDS + (["geo_sid"] if extra is None else extra)
    return df.selectExpr(*(keep or []), *[field(n) for n in wanted])
