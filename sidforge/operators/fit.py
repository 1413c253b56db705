"""Fitting codebooks with distributed k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidforge.functions.vectors import sanitize
from sidforge.operators import kmeans, quantize
from sidforge.operators.balance import sinkhorn_codes
from sidforge.operators.project import mlp_project
from sidforge.operators.quantize import assign_codes, codebook_bytes, fetch_levels, group_means
from sidforge.operators.sampling import block_sample, shuffle_batches
from sidforge.session import discard, materialize
from sidforge.sources.vectors import valid_shape

CODEBOOK_SCHEMA = "level int, code int, centroid array<double>"


def codebook_table(spark: SparkSession, levels: list[list[list[float]]]) -> DataFrame:
    rows = [
        (level, code, [float(x) for x in word])
        for level, book in enumerate(levels)
        for code, word in enumerate(book)
    ]
    return spark.createDataFrame(rows, T._parse_datatype_string(CODEBOOK_SCHEMA))


def uniform_codebook(
    spark: SparkSession, k: int, dim: int, seed: int = 2024, level: int = 0
) -> DataFrame:
    """Codewords drawn evenly from ±1/k, reproducible from (seed, level, code, place)."""
    place = F.concat_ws(
        "-", F.lit(str(seed)), F.lit(str(level)), F.col("id").cast("string"), F.col("p").cast("string")
    )
    unit = F.conv(F.substring(F.md5(place.cast("binary")), 1, 8), 16, 10).cast("double") / (
        F.lit(4294967296.0)
    )
    cells = spark.range(k).select("id", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("p"))
    words = cells.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("p", ((unit * 2 - 1) / F.lit(float(k))).alias("x"))))
        .alias("cells")
    )
    return words.select(
        F.lit(level).alias("level"), F.col("id").cast("int").alias("code"),
        F.col("cells.x").alias("centroid"),
    )


def fit_codebook(
    df: DataFrame,
    k: int,
    iters: int = 100,
    restarts: int = 2,
    seed: int = 2024,
    vec: str = "embedding",
    level: int = 0,
    start: DataFrame | None = None,
    tolerance: float = kmeans.TOLERANCE,
) -> DataFrame:
    """k-means centres of the vectors, the cheapest of several restarts.

    Restarts are updated side by side on distinct vectors (``operators/kmeans.py``). ``start``
    names their first centres instead: a codebook whose levels are the restarts. Fewer than
    ``k`` rows is an error, as are null and ragged vectors; NaN and infinite elements become 0.
    Where there are fewer distinct vectors than codes, centres repeat, which changes no
    assignment because the lowest code wins a tie. Of equally cheap restarts the first counts.
    """
    rows = valid_shape(df, vec).n
    if rows < k:
        raise ValueError(f"{rows} samples cannot fill {k} codes")
    starts = None
    if start is not None:
        levels = fetch_levels(start)
        if levels is None or any(len(words) != k for words in levels):
            raise ValueError(f"the first centres must be {k} to a restart, within the broadcast limit")
        starts = np.stack(levels)
    points = kmeans.distinct_points(df, vec)
    fitted = kmeans.fit_centres(points, k, iters, restarts, seed, starts, tolerance)
    discard(points)
    best = fitted.centres[int(fitted.costs.argmin())]
    return codebook_table(df.sparkSession, [best.tolist()]).withColumn("level", F.lit(level))


def fit_rq(
    df: DataFrame,
    num_emb_list: list[int],
    sample_n: int = 0,
    layers: DataFrame | None = None,
    activation: str | None = "relu",
    iters: int = 100,
    restarts: int = 2,
    seed: int = 2024,
    vec: str = "embedding",
    idx: str = "idx",
    start: DataFrame | None = None,
    tolerance: float = kmeans.TOLERANCE,
) -> DataFrame:
    """Codebooks of all levels, fitted one after the other.

    The rows are projected (if layers are given); each level clusters what the
    levels before it left over. ``sample_n`` asks for a block sample instead of all rows,
    ``start`` for given first centres of each level instead of restarts.
    """
    sample = df.select(idx, vec)
    if sample_n:
        sample = block_sample(sample, sample_n, seed=seed, idx=idx)
    if layers is not None:
        sample = mlp_project(sample, layers, activation, vec, "_latent").select(
            idx, F.col("_latent").alias(vec)
        )
    rest = materialize(sample.select(idx, sanitize(vec).cast("array<double>").alias(vec)), "rest")
    books = None
    for level, k in enumerate(num_emb_list):
        first = None if start is None else start.where(F.col("level") == level).withColumn("level", F.lit(0))
        book = fit_codebook(rest, k, iters, restarts, seed, vec, level, first, tolerance)
        books = book if books is None else books.unionByName(book)
        if level + 1 < len(num_emb_list):
            left = assign_codes(rest, book.withColumn("level", F.lit(0)), vec, [idx], residual=True)
            left = left.select(idx, F.col("residual").alias(vec))
            rest = materialize(left, "rest", replaces=rest)
    return books


def fit_balanced(
    df: DataFrame,
    start: DataFrame,
    epsilons: list[float],
    steps: int,
    batch_rows: int = 1024,
    iters: int = 50,
    vec: str = "embedding",
    idx: str = "idx",
    batch: str | None = None,
    seed: int = 2024,
) -> DataFrame:
    """Refine the codebook ``start`` with balanced assignment inside, all levels in turn.

    In every step each level assigns what the levels before it left over, balanced within
    batches where its ``epsilons`` entry is positive and to the nearest codeword elsewhere. Its
    codewords move to the mean of what they were given, then the rest goes on to the next
    level. A codeword nobody took stays. Each step shuffles the rows into new batches of
    ``batch_rows``, or keeps those in the column ``batch``.
    """
    valid_shape(df, vec)
    kept = [idx] if batch is None else [idx, batch]
    rows = materialize(df.select(*kept, sanitize(vec).cast("array<double>").alias("_rest")), "vectors")
    book, written = start, None
    for step in range(steps):
        current, name = rows, batch
        if batch is None:
            current, name = shuffle_batches(rows, step, seed, batch_rows, idx), "batch"
        moved, last = [], None
        for level, eps in enumerate(epsilons):
            coded = sinkhorn_codes(current, book, name, idx, "_rest", level, eps, iters, carry=["_rest"])
            coded = materialize(coded, "balanced", replaces=last)
            old = book.where(F.col("level") == level)
            means = group_means(coded, ["code"], "_rest", "_mean")
            words = old.join(means, "code", "left").select("level", "code", F.coalesce("_mean", "centroid").alias("centroid"))
            words = materialize(words.coalesce(1), "words")
            moved.append(words)
            near = words.select("code", F.col("centroid").alias("_word"))
            if codebook_bytes(words) <= quantize.BROADCAST_BYTES:
                near = F.broadcast(near)
            left = F.expr("zip_with(_rest, _word, (v, w) -> v - w)").alias("_rest")
            current, last = coded.join(near, "code").select(idx, name, left), coded
        book = moved[0]
        for words in moved[1:]:
            book = book.unionByName(words)
        book = materialize(book.coalesce(1), "codebook", replaces=written)
        written = book
        for table in (*moved, last):
            discard(table)
    discard(rows)
    return book
