"""Item, vector and codebook tables derived from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidforge.operators.quantize import group_means
from sidforge.session import materialize

LEVELS = 3
CODES = 16
# Stretch of the centroids per level. Means of many vectors are short; the
# stretch brings them near the length of what they quantize.
GAINS = [4.0, 2.4, 1.44]

# One text for both engines: {S} is the string type, {T} a double 1000.
ITEMS_SQL = """
select p_partkey as idx, cast(p_partkey as {S}) as item_id, cast(p_size as {S}) as sence_id,
  case when p_partkey % 13 = 0 then ' ' || p_name || '  ' else p_name end as title,
  case when p_partkey % 7 = 0 then '' else p_type end as description,
  case when p_partkey % 17 = 0 then cast(null as {S}) else p_brand end as brand,
  cast(p_partkey % 10 as {S}) as shop_id,
  case when p_partkey % 11 = 0 then cast(null as {S})
       when p_partkey % 23 = 0 then '  '
       when p_partkey % 29 = 0 then 'abc'
       else cast(((p_partkey * 7919) % 360000 - 180000) / {T} as {S}) end as i_lng,
  case when p_partkey % 19 = 0 then cast(null as {S})
       else cast(((p_partkey * 104729) % 180000 - 90000) / {T} as {S}) end as i_lag,
  '20240101' as dt,
  case p_partkey % 3 when 0 then 'MX' when 1 then 'BR' else 'CO' end as country_code
from {part}
"""

# Non-finite and missing elements spread over all vectors.
DIRTY_SQL = """
case when (vec_id * 64 + i) % 97 = 0 then {nan} when (vec_id * 64 + i) % 89 = 0 then {inf}
     when (vec_id * 64 + i) % 83 = 0 then -{inf} when (vec_id * 64 + i) % 79 = 0 then null
     else x end
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw items with missing, blank and malformed coordinates."""
    text = ITEMS_SQL.format(S="string", T="1000D", part="{part}")
    return spark.sql(text, part=read(spark, sf_dir, "part"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector per item; several items share one."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    keyed = spark.sql(
        "select p_partkey as idx, p_partkey % (select count(*) from {vectors}) as vec_id from {part}",
        part=read(spark, sf_dir, "part"),
        vectors=vectors,
    )
    return keyed.join(vectors, "vec_id").select("idx", "embedding")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct vectors, numbered by ``idx``."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of stretched class means over the whole vector table.

    A vector belongs to class ``(vec_id + level * label) % 16`` of each level.
    """
    table = read(spark, sf_dir, "embeddings")
    levels = table.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(LEVELS)])))
    code = ((F.col("vec_id") + F.col("level") * F.col("label")) % CODES).cast("int")
    means = group_means(levels.withColumn("code", code), ["level", "code"], "embedding")
    gain = F.element_at(F.array(*[F.lit(g) for g in GAINS]), F.col("level") + 1)
    stretched = F.transform("centroid", lambda x: x * gain)
    return materialize(means.withColumn("centroid", stretched), "codebook")


def dirty_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with NaN, infinite and null elements."""
    case = DIRTY_SQL.format(nan="float('nan')", inf="float('inf')")
    return read(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", f"transform(embedding, (x, i) -> {case}) as embedding"
    )


def layers(spark: SparkSession, book: DataFrame) -> DataFrame:
    """Two dense layers: the first codebook level, then a small mixing layer."""
    first = book.where("level = 0").select(
        F.lit(0).alias("layer"), F.col("code").alias("unit"), F.col("centroid").alias("weights"),
        (F.col("code") / F.lit(100.0)).alias("bias"),
    )
    second = book.where("level = 1").selectExpr(
        "1 as layer", "code as unit",
        f"transform(sequence(0, {CODES - 1}), i -> ((i * 7 + code * 3) % 11 - 5) / 10D) as weights",
        "code / 10D as bias",
    )
    return first.unionByName(second)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated fits derived from orders: seven runs of many epochs."""
    return spark.sql(
        """select cast(o_custkey % 7 as string) as run,
                  cast(row_number() over (partition by o_custkey % 7 order by o_orderkey) - 1 as int) as epoch,
                  o_totalprice / 100000D as loss,
                  floor(o_totalprice / 5000D) / 100D as collision_rate
           from {orders}""",
        orders=read(spark, sf_dir, "orders"),
    )
