"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a hash. A document's virtual finish time is the
number of source tokens up to and including it, divided by the source's target, so every
source reaches 1 when its target is used up. A second pass over a source continues where the
first ended. All finish times are sorted by range and cut where the total budget is spent.
A source without a target has no finish times and is never taken.

Tokens are runs of characters other than ASCII white space. A null text has none and a
document without tokens is never taken. A null source is a source of its own, sorted last.
Rows equal in id, source and size share one place in the queue and one decision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.operators.identity import with_idx
from sidforge.session import materialize

WEIGHTS = (3, 1, 2)
BUDGET = 1.5  # of all tokens
PASSES = 2  # over one source at most
SEED = "mix"
PART_ROWS = 20_000  # rows that one task sorts, on average


def token_count(text: str | Column) -> Column:
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[ \t\n\x0B\f\r]+")
    return F.size(F.array_remove(parts, "")).cast("bigint")


def source_targets(sizes: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``(source, source_rank, source_size, target)`` from ``sizes`` (source, source_size).

    The level that fills the uncapped sources is found by repeated sums; each round caps
    the sources that are above it, so the rounds end. Only two numbers reach the driver.
    """
    # Null sorts behind every source.
    ranked = with_idx(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "source_rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = materialize(ranked.drop("_last").withColumn("_weight", weight), "sources")
    most = F.col("source_size") * PASSES
    total = ranked.agg(F.sum("source_size").alias("n")).first().n or 0
    level, before = 0.0, None
    while True:
        capped = most <= F.col("_weight") * F.lit(level)
        sums = ranked.agg(
            F.sum(F.when(capped, most)).alias("full"), F.sum(F.when(~capped, F.col("_weight"))).alias("weights")
        ).first()
        if not sums.weights or (sums.full, sums.weights) == before:
            break
        before = (sums.full, sums.weights)
        level = (budget * total - (sums.full or 0)) / sums.weights
    filled = F.least(most.cast("double"), F.col("_weight") * F.lit(float(level)))
    return ranked.select("source", "source_rank", "source_size", filled.alias("target"))


def mix(sized: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Decisions for ``sized`` (doc_id, source, size): one row per distinct row, with
    ``source_size``, ``target`` and ``taken``, the tokens taken with repeats."""
    rows = materialize(sized.select("doc_id", "source", "size"), "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, budget)
    count = rows.count()

    same = F.expr("r.source <=> t.source")
    placed = rows.alias("r").join(targets.alias("t"), same, "left")
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    placed = placed.select("r.*", "source_rank", "source_size", "target", key.alias("_key"))
    digits = max(1, math.ceil(math.log(max(count / PART_ROWS, 1), 16)))
    placed = placed.withColumn("_bucket", F.substring("_key", 1, digits))

    # Tokens before each bucket: at most 16^digits numbers per source.
    buckets = placed.groupBy("source_rank", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = W.partitionBy("source_rank").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    # Equal rows are peers: a range frame gives them the same sum.
    within = W.partitionBy("source_rank", "_bucket").orderBy("_key", "doc_id", "size")
    queued = placed.withColumn("_upto", F.sum("size").over(within)).join(buckets, ["source_rank", "_bucket"])
    queued = materialize(
        queued.select(
            "doc_id", "source", "size", "source_rank", "source_size", "target", "_key",
            (F.col("_before") + F.col("_upto")).alias("_tokens"),
        ),
        "queued",
        replaces=rows,
    )

    def finish(passed: Column) -> Column:
        # Evaluated for every row, before any condition on it.
        return F.try_divide(F.col("source_size") * passed + F.col("_tokens"), F.col("target"))

    entry = "_finish", "source_rank", "_key", "doc_id", "size"
    passes = F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1)))
    entries = queued.where("size > 0 and target > 0").withColumn("_pass", passes).withColumn("_finish", finish(F.col("_pass")))
    # Finish times are spread evenly, so equal steps cut them into even ranges.
    steps = max(16, count // PART_ROWS)
    entries = entries.withColumn("_range", F.floor(F.least(F.col("_finish"), F.lit(4.0)) * steps))
    spent = entries.groupBy("_range").agg(F.sum("size").alias("_sum"))
    spent = spent.withColumn("_end", F.sum("_sum").over(W.orderBy("_range")))  # a row per range
    total = targets.agg(F.sum("target").alias("n")).first().n or 0.0
    over = spent.where(F.col("_end") > F.lit(float(total))).sort("_range").first()
    decided = queued.select("doc_id", "source", "size", "source_size", "target")
    if over is None:
        takes = [F.lit(True)] * PASSES
    else:
        rest = float(total) - (over["_end"] - over["_sum"])
        cut = entries.where(F.col("_range") == over["_range"])
        cut = cut.withColumn("_run", F.sum("size").over(W.partitionBy("_range").orderBy(*entry)))
        last = cut.where(F.col("_run") <= F.lit(rest)).select(F.max(F.struct(*entry)).alias("m")).first().m
        decided = queued
        takes = []
        for n in range(PASSES):
            place = F.struct(finish(F.lit(n)).alias("_finish"), *entry[1:])
            below = F.floor(F.least(finish(F.lit(n)), F.lit(4.0)) * steps) < over["_range"]
            if last is not None:
                kinds = ("double", "bigint", "string", "bigint", "bigint")
                edge = F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(last, kinds, entry)))
                below = below | (place <= edge)
            takes.append(below)
    taken = sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & t, F.col("size")).otherwise(0) for t in takes), F.lit(0))
    taken = taken.cast("bigint").alias("taken")
    return decided.select("doc_id", "source", "size", "source_size", "target", taken)


def mix_documents(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it: PASSES times, fewer or never."""
    size = token_count("text")
    decisions = mix(docs.select("doc_id", "source", size.alias("size")), budget)
    # Equal rows carry equal decisions.
    wanted = decisions.where("taken > 0").distinct()
    times = wanted.select("doc_id", "source", "size", F.expr("cast(taken / size as int)").alias("_times"))
    same = F.expr("d.doc_id <=> t.doc_id and d.source <=> t.source and d._size = t.size")
    met = docs.withColumn("_size", size).alias("d").join(times.alias("t"), same)
    copies = met.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
    return copies.drop("_copy")
