"""Choosing among evaluated fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _leading(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows of each run; tasks drop the rest before the shuffle."""
    place = F.row_number().over(W.partitionBy("run").orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n)


def best_rates(runs: DataFrame, save_limit: int) -> DataFrame:
    """``(run, epoch)`` of the ``save_limit`` lowest collision rates.

    Equal rates at the border: only an epoch among the first ``save_limit`` that
    are at least as good gets in, and a better late-comer evicts the one whose
    file name ``epoch_<n>_...`` sorts first.
    """
    lowest = _leading(runs, save_limit, "collision_rate", "epoch")
    borders = lowest.groupBy("run").agg(F.max("collision_rate").alias("_border"))
    better = lowest.join(borders, "run").where("collision_rate < _border")
    slots = better.groupBy("run").agg(F.count("*").alias("_taken"))
    # One row per run is broadcast or shuffled as its size asks.
    good = runs.join(borders, "run").where("collision_rate <= _border")
    ties = _leading(good, save_limit, "epoch").where("collision_rate = _border")
    name = F.concat(F.col("epoch").cast("string"), F.lit("_"))
    place = F.row_number().over(W.partitionBy("run").orderBy(F.desc(name)))
    kept_ties = (
        ties.withColumn("_tie", place)
        .join(slots, "run", "left")
        .where(F.col("_tie") <= F.lit(save_limit) - F.coalesce("_taken", F.lit(0)))
    )
    return better.select("run", "epoch").unionByName(kept_ties.select("run", "epoch"))


def select_models(runs: DataFrame, save_limit: int = 5) -> DataFrame:
    """Flag, per run, the epochs worth keeping.

    ``runs`` holds ``(run, epoch, loss, collision_rate)``, one row per evaluated
    epoch. ``best_loss`` and ``best_collision`` mark the earliest minimum;
    ``kept`` marks the newest ``save_limit`` epochs and those of
    :func:`best_rates`. A run of any length leaves at most a few rows per task
    before anything is shuffled.
    """
    minima = runs.groupBy("run").agg(
        F.min(F.struct("loss", "epoch"))["epoch"].alias("_loss"),
        F.min(F.struct("collision_rate", "epoch"))["epoch"].alias("_rate"),
    )
    newest = _leading(runs, save_limit, F.desc("epoch")).select("run", "epoch")
    marks = (
        minima.select("run", F.col("_loss").alias("epoch"), F.lit("loss").alias("mark"))
        .unionByName(minima.select("run", F.col("_rate").alias("epoch"), F.lit("rate").alias("mark")))
        .unionByName(newest.withColumn("mark", F.lit("kept")))
        .unionByName(best_rates(runs, save_limit).withColumn("mark", F.lit("kept")))
    )
    flags = marks.groupBy("run", "epoch").agg(
        F.bool_or(F.col("mark") == "loss").alias("best_loss"),
        F.bool_or(F.col("mark") == "rate").alias("best_collision"),
        F.bool_or(F.col("mark") == "kept").alias("kept"),
    )
    no = F.lit(False)
    return runs.join(flags, ["run", "epoch"], "left").select(
        "run", "epoch", "loss", "collision_rate",
        F.coalesce("best_loss", no).alias("best_loss"),
        F.coalesce("best_collision", no).alias("best_collision"),
        F.coalesce("kept", no).alias("kept"),
    )
