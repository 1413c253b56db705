"""Reports on codes and vectors."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.functions.tokens import code_columns, code_token, parse_code
from sidforge.functions.vectors import norm
from sidforge.operators.collisions import bucket_sizes, size_histogram
from sidforge.operators.order import quantiles
from sidforge.operators.sampling import row_sample
from sidforge.operators.skew import join_counted
from sidforge.session import materialize

log = logging.getLogger(__name__)

# How many codes and buckets the report lists, and its percentiles.
TOP_CODES = 5
TOP_BUCKETS = 100
PERCENTILES = [50, 90, 99]


def parse_index(df: DataFrame) -> DataFrame:
    """Code tokens of an index table as integers."""
    return df.withColumns({c: parse_code(c) for c in code_columns(df)})


def level_usage(df: DataFrame, code_cols: list[str] | None = None) -> DataFrame:
    """Per level: codes used, highest code + 1, entropy against its maximum,
    share of the five largest codes and of the largest."""
    cols = code_cols or code_columns(df)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(i).alias("level"), F.col(c).alias("code")) for i, c in enumerate(cols)])
    ).alias("pair")
    counts = df.select(pairs).select("pair.*").groupBy("level", "code").agg(F.count("*").alias("n"))
    # From here on one row per code in use.
    level = W.partitionBy("level")
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(level)).withColumn(
        "place", F.row_number().over(level.orderBy(F.desc("n"), "code"))
    )
    entropy = -F.sum(F.col("p") * F.log2("p"))
    ranked = F.when(F.col("place") <= TOP_CODES, F.col("p"))
    return shares.groupBy("level").agg(
        F.count("*").alias("used"),
        (F.max("code") + 1).cast("bigint").alias("slots"),
        F.when(F.count("*") > 1, entropy / F.log2(F.count("*").cast("double")))
        .otherwise(F.lit(0.0))
        .alias("entropy_ratio"),
        F.sum(ranked).alias("top5_share"),
        F.max("p").alias("top1_share"),
    )


def top_buckets(
    df: DataFrame, n: int = TOP_BUCKETS, code_cols: list[str] | None = None
) -> DataFrame:
    """The ``n`` largest buckets as rendered SID and size; ties by SID."""
    cols = code_cols or code_columns(df)
    rendered = F.concat(*[code_token(i, c) for i, c in enumerate(cols)])
    buckets = bucket_sizes(df, cols).select(rendered.alias("sid"), F.col("n").alias("bucket_size"))
    return buckets.orderBy(F.desc("bucket_size"), "sid").limit(n)


def bucket_percentiles(df: DataFrame, code_cols: list[str] | None = None) -> DataFrame:
    """Percentiles of the bucket size, interpolated and cut to whole numbers.

    Weighted by the size histogram, so one task sees each distinct size once.
    """
    sizes = size_histogram(bucket_sizes(df, code_cols or code_columns(df)))
    return sizes.agg(
        *[
            F.floor(F.expr(f"percentile(n, {q / 100}, buckets)")).cast("bigint").alias(f"p{q}")
            for q in PERCENTILES
        ]
    )


def exclusive_items(df: DataFrame, code_cols: list[str] | None = None) -> DataFrame:
    """Items alone in their bucket: number and share."""
    sizes = size_histogram(bucket_sizes(df, code_cols or code_columns(df)))
    alone = F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("buckets"))), F.lit(0))
    total = F.sum(F.col("n") * F.col("buckets"))
    return sizes.agg(
        alone.alias("exclusive"), F.try_divide(alone.cast("double"), total).alias("exclusive_share")
    )


def geo_collision(df: DataFrame, code_cols: list[str] | None = None) -> DataFrame:
    """Collision figures of (geohash, codes) beside those of the codes alone.

    Rows are counted once per (geohash, codes); the plain buckets are summed
    from those counts. Without a geohash column only the plain row remains.
    """
    cols = code_cols or code_columns(df)
    has_geo = "geohash" in df.columns
    if not has_geo:
        log.warning("no geohash column, the geohash row is left out")
        fine = bucket_sizes(df, cols)
        return _bucket_summary(fine, "sid")
    filled = df.withColumn("geohash", F.coalesce("geohash", F.lit("")))
    fine = bucket_sizes(filled, ["geohash", *cols])
    coarse = fine.groupBy(*cols).agg(F.sum("n").alias("n"))
    return _bucket_summary(fine, "geo_sid").unionByName(_bucket_summary(coarse, "sid"))


def distinct_geohashes(df: DataFrame) -> DataFrame:
    """One row: distinct geohashes, null counted as the empty one."""
    return df.agg(F.count_distinct(F.coalesce("geohash", F.lit(""))).alias("geohashes"))


def _bucket_summary(buckets: DataFrame, scope: str) -> DataFrame:
    sizes = size_histogram(buckets)
    total = F.sum(F.col("n") * F.col("buckets"))
    unique = F.sum("buckets")
    alone = F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("buckets"))), F.lit(0))
    return sizes.agg(
        F.lit(scope).alias("scope"),
        total.alias("total"),
        unique.alias("unique_sids"),
        F.max("n").alias("max_bucket"),
        F.try_divide((total - unique).cast("double"), total).alias("rate"),
        alone.alias("exclusive"),
        F.try_divide(alone.cast("double"), total).alias("exclusive_share"),
    )


def geo_collision_sets(df: DataFrame, code_cols: list[str] | None = None) -> DataFrame:
    """:func:`geo_collision` from one ``GROUPING SETS`` aggregate."""
    cols = code_cols or code_columns(df)
    filled = df.withColumn("geohash", F.coalesce("geohash", F.lit("")))
    grouped = filled.groupingSets(
        [[F.col("geohash"), *map(F.col, cols)], [F.col(c) for c in cols]],
        F.col("geohash"), *map(F.col, cols),
    ).agg(F.count("*").alias("n"), F.grouping("geohash").alias("plain"))
    n, alone = F.col("n"), F.count_if(F.col("n") == 1)
    return grouped.groupBy(
        F.when(F.col("plain") == 1, "sid").otherwise("geo_sid").alias("scope")
    ).agg(
        F.sum(n).alias("total"),
        F.count("*").alias("unique_sids"),
        F.max(n).alias("max_bucket"),
        ((F.sum(n) - F.count("*")).cast("double") / F.sum(n)).alias("rate"),
        alone.alias("exclusive"),
        (alone.cast("double") / F.sum(n)).alias("exclusive_share"),
    )


def norm_stats(
    df: DataFrame, sample_n: int = 0, seed: int = 0, vec: str = "embedding", idx: str = "idx"
) -> DataFrame:
    """L2 norms: rows, extremes, median, mean, population deviation.

    All rows unless ``sample_n`` asks for a row sample. The median is selected by counting
    digits, so no norm is sorted or shuffled. A null vector counts as a row only.
    """
    table = df.select(idx, vec)
    if sample_n:
        table = row_sample(table, sample_n, seed, idx, False)
    length = materialize(table.select(norm(vec).alias("x")), "norms")
    median = quantiles(length, [0.5])[0]
    stats = length.agg(
        F.count("*").alias("n"),
        F.min("x").alias("min_norm"),
        F.lit(median).cast("double").alias("median_norm"),
        F.avg("x").alias("mean_norm"),
        F.max("x").alias("max_norm"),
        F.stddev_pop("x").alias("std_norm"),
    )
    return stats


def dup_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: rows, distinct vectors, repeats and their share, which bounds
    the collision rate from below.

    Two 64- and 32-bit hashes travel in place of the vectors. A hash pair seen
    once is a distinct vector; only rows of repeated pairs are compared by value.
    """
    # Adding 0.0 turns -0.0 into 0.0, which it equals.
    value = F.transform(vec, lambda x: x + F.lit(0.0).cast("float"))
    rows = df.select(value.alias("v")).select(
        "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")
    )
    pairs = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    once = pairs.agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("distinct"))
    repeated = pairs.where("n > 1")
    values = join_counted(rows, repeated, ["h1", "h2"], how="left_semi").select("v").distinct()
    shared = values.agg(F.lit(0).cast("bigint").alias("total"), F.count("*").alias("distinct"))
    both = once.unionByName(shared).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.sum("distinct").alias("distinct_vectors")
    )
    repeats = F.col("total") - F.col("distinct_vectors")
    return both.select(
        "total",
        "distinct_vectors",
        repeats.alias("repeats"),
        F.try_divide(repeats * F.lit(100.0), F.col("total")).alias("repeat_pct"),
    )


def dup_vectors_sample(
    df: DataFrame, sample_n: int = 200_000, seed: int = 0, vec: str = "embedding", idx: str = "idx"
) -> DataFrame:
    """:func:`dup_vectors` within a row sample."""
    return dup_vectors(row_sample(df.select(idx, vec), sample_n, seed, idx, False), vec)
