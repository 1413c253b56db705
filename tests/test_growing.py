"""Indexes that grow, sinks that check themselves, figures counted on the way."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sidforge.operators import collisions, growing
from sidforge.sources import sinks, vectors

SCHEMA = "idx bigint, code_0 int, code_1 int"


@pytest.fixture(scope="module")
def codes(spark):
    rng = random.Random(6)
    return spark.createDataFrame([(i, rng.randrange(3), rng.choice((0, 0, 0, 1, 2))) for i in range(600)], SCHEMA)


def test_batches_equal_one_run_also_when_repeated(spark, folder, codes, monkeypatch):
    monkeypatch.setattr(growing, "SNAPSHOT_EVERY", 2)
    for number in (0, 1, 2, 2, 3, 3, 4):
        growing.add_batch(codes.where(F.expr("idx div 120") == number), folder, number, chunk_rows=20)
    whole = sorted(map(tuple, collisions.dedup_rank(codes).collect()))
    assert sorted(map(tuple, growing.read_index(spark, folder).drop("batch").collect())) == whole
    # An earlier batch that is run again does not see what came later.
    growing.add_batch(codes.where("idx div 120 = 1"), folder, 1)
    assert sorted(map(tuple, growing.read_index(spark, folder).drop("batch").collect())) == whole


def test_later_items_rank_behind_whatever_their_number(spark, folder):
    growing.add_batch(spark.createDataFrame([(9, 1, 1), (8, 1, 1)], SCHEMA), folder, 0)
    growing.add_batch(spark.createDataFrame([(1, 1, 1), (2, 0, 0)], SCHEMA), folder, 1)
    growing.add_batch(spark.createDataFrame([], SCHEMA), folder, 2)
    rows = {r.idx: r.code_2 for r in growing.read_index(spark, folder).collect()}
    assert rows == {8: 1, 9: 2, 1: 3, 2: 1}


def test_one_changed_value_stops_the_job(spark, folder):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) as s", "array(float(id), null) as v")

    def damaged():
        back = spark.read.parquet(folder + "/t")
        return back.withColumn("s", F.when(F.col("id") == 500, "x").otherwise(F.col("s")))

    write = lambda rows: rows.write.mode("overwrite").parquet(folder + "/t")
    assert sinks.write_verified(df, write, lambda: spark.read.parquet(folder + "/t")).count() == 1000
    with pytest.raises(ValueError, match="wrote 1000 rows"):
        sinks.write_verified(df, write, damaged)
    with pytest.raises(ValueError, match="read 999"):
        sinks.write_verified(df, write, lambda: spark.read.parquet(folder + "/t").where("id <> 3"))
    twice = lambda: spark.read.parquet(folder + "/t").where("id <> 3").union(df.where("id = 4"))
    with pytest.raises(ValueError, match="hash sum"):
        sinks.write_verified(df, write, twice)
    empty = sinks.write_verified(df.where("false"), write, lambda: spark.read.parquet(folder + "/t"))
    assert empty.count() == 0


def test_figures_are_counted_on_the_way(spark):
    rows = [(1, [1.0, float("nan"), None]), (2, [float("inf"), 2.0]), (3, None)]
    df = spark.createDataFrame(rows, "idx bigint, embedding array<float>")
    seen = Observation()
    vectors.observe_vectors(df, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "nulls": 1, "min_dim": 2, "max_dim": 3, "nan_values": 2, "inf_values": 1}
