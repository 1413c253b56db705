"""Balanced assignment (Sinkhorn) per batch.

Q starts as ``exp(-centred distance / eps)``; rows and columns are normalised in
turn, and a row takes the code with its largest entry. Row and column scaling
only multiply Q by a weight per row and a weight per code, and the row weight
follows from the code weights. The whole state of a batch is therefore one
weight per code:

* a batch that fits a task is solved there (``applyInArrow``);
* a larger batch stays spread over the tasks; each pass sums one number per
  code in every task, and only those sums meet. No batch is gathered.

Vectors travel, not distances: the solving task measures them itself.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidforge.operators import kernels as k
from sidforge.operators.identity import with_idx
from sidforge.operators.quantize import (
    _arrow_map,
    _column,
    _one_level,
    assign_codes,
    codebook_distances,
    decode,
    fetch_levels,
)
from sidforge.operators.skew import join_counted
from sidforge.session import discard, materialize

# A batch with up to this many numbers (rows x codes, rows x width) is solved in one task.
TASK_CELLS = 1 << 24
# Larger batches handled side by side, and the bytes of their weights on the driver.
BATCHES_AT_ONCE = 4096
WEIGHT_BYTES = 32 << 20
# Names of larger batches that are broadcast to sort rows into the two ways.
BROADCAST_NAMES = 2_000_000


def center_distances(df: DataFrame, batch: str, dist: str = "distances") -> DataFrame:
    """Shift and scale distances to [-1, 1] by the extremes of their batch."""
    ends = df.groupBy(batch).agg(
        F.min(F.array_min(dist)).alias("_low"), F.max(F.array_max(dist)).alias("_high"),
        F.count("*").alias("_n"),
    )
    return _centred(join_counted(df, ends, [batch], "_n"), dist)


def _centred(df: DataFrame, dist: str) -> DataFrame:
    """Distances of rows that carry ``_low`` and ``_high`` of their batch, without the two."""
    middle = (F.col("_high") + F.col("_low")) / 2
    centred = F.transform(
        dist, lambda d: (d - F.col("_middle")) / (F.col("_high") - F.col("_middle") + F.lit(1e-5))
    )
    return df.withColumn("_middle", middle).withColumn(dist, centred).drop("_low", "_high", "_middle", "_n")


def center_codebook_distances(
    df: DataFrame, codebook: DataFrame, batch: str, level: int = 0, vec: str = "embedding", dist: str = "distances"
) -> DataFrame:
    """:func:`center_distances` of vectors to one level of a codebook.

    Vectors meet the extremes of their batch, so distances are measured once for the extremes
    and once for the result, and none is shuffled or written. With a codebook beyond the
    broadcast limit they are measured block by block first.
    """
    book = _one_level(codebook, level)
    levels = fetch_levels(book)
    if levels is None:
        return center_distances(codebook_distances(df, book, 0, vec), batch)
    shipped = df.sparkSession.sparkContext.broadcast(levels[0])

    def ends_of(piece):
        words = shipped.value
        d = k.distances(k.clean_matrix(_column(piece, vec), words.shape[1]), words)
        return {"_low": pa.array(d.min(axis=1)), "_high": pa.array(d.max(axis=1))}

    added = [T.StructField(c, T.DoubleType()) for c in ("_low", "_high")]
    found = _arrow_map(df, [batch, vec], added, ends_of, [batch])
    ends = found.groupBy(batch).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.count("*").alias("_n"))
    met = join_counted(df, materialize(ends, "ends"), [batch], "_n")
    return _centred(codebook_distances(met, book, 0, vec), dist)


class _Measured(NamedTuple):
    """How a task gets distances (and what a code leaves over) from the column it is sent."""

    column: str
    codes: int
    cells: int
    measure: Callable[[pa.Array], np.ndarray]
    left_over: Callable[[pa.Array, np.ndarray], np.ndarray] | None = None


def rows_per_task(cells: int) -> int:
    return max(1, TASK_CELLS // max(1, cells))


def _plain_argmin(df: DataFrame, dist: str) -> DataFrame:
    lowest = F.array_position(F.col(dist), F.array_min(dist)) - 1
    return df.withColumn("code", lowest.cast("int"))


def sinkhorn_assign(
    df: DataFrame,
    batch: str,
    key: str = "idx",
    eps: float = 0.003,
    iters: int = 50,
    dist: str = "distances",
    task_rows: int | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Balanced code per row of a table with a distance to every code: ``(key, batch, code)``
    and the columns in ``carry`` before the code.

    ``eps <= 0`` means plain nearest codes. The ratio 2/eps must stay within the range of a
    double exponential, so a positive ``eps`` below 0.00286 is refused. A batch above
    ``task_rows`` rows (default: by TASK_CELLS) is solved over all tasks.
    """
    _check(eps)
    kept = [key, batch, *(carry or [])]
    df = df.select(*kept, dist)
    if eps <= 0:
        return _plain_argmin(df, dist).select(*kept, "code")
    first = df.select(F.size(dist)).first()
    codes = first[0] if first else 1
    return _solve(df, batch, kept, eps, iters, _Measured(dist, codes, codes, k.to_matrix), task_rows)


def sinkhorn_codes(
    df: DataFrame,
    codebook: DataFrame,
    batch: str,
    key: str = "idx",
    vec: str = "embedding",
    level: int = 0,
    eps: float = 0.003,
    iters: int = 50,
    task_rows: int | None = None,
    carry: list[str] | None = None,
    residual: bool = False,
) -> DataFrame:
    """:func:`sinkhorn_assign` for vectors and one level of a codebook.

    ``residual`` adds what the code leaves over. With a codebook beyond the broadcast limit
    the distances are written first, block by block; the rows are the same.
    """
    _check(eps)
    book = _one_level(codebook, level)
    carry = [c for c in carry or [] if c not in (key, batch)]
    kept = [key, batch, *carry]
    if eps <= 0:
        # Carried columns may be named like the code that is added.
        table = df.select(F.struct(*kept).alias("_kept"), F.col(vec).alias("_vector"))
        coded = assign_codes(table, book, "_vector", ["_kept"], residual=residual)
        return coded.select("_kept.*", F.col("code_0").alias("code"), *["residual"] * residual)
    levels = fetch_levels(book)
    if levels is not None:
        words = levels[0]
        shipped = df.sparkSession.sparkContext.broadcast(words)

        def vectors(column: pa.Array) -> np.ndarray:
            return k.clean_matrix(column, shipped.value.shape[1])

        source = _Measured(
            "_vector", len(words), max(words.shape),
            lambda column: k.distances(vectors(column), shipped.value),
            (lambda column, code: vectors(column) - shipped.value[code]) if residual else None,
        )
        return _solve(df.select(*kept, F.col(vec).alias("_vector")), batch, kept, eps, iters, source, task_rows)
    table = df.select(*kept, F.col(vec).alias("_vector"))
    measured = codebook_distances(table, book, 0, "_vector")
    solved = sinkhorn_assign(measured, batch, key, eps, iters, task_rows=task_rows, carry=[*carry, "_vector"])
    if not residual:
        return solved.drop("_vector")
    named = solved.select(F.struct(*kept).alias("_kept"), "_vector", F.col("code").alias("code_0"))
    words = decode(named, book, "_word")
    left = F.expr("zip_with(_vector, _word, (v, w) -> double(v) - w)")
    return words.select("_kept.*", F.col("code_0").alias("code"), left.alias("residual"))


def _check(eps: float) -> None:
    if eps > 0 and 2.0 / eps > 700:
        raise ValueError(f"eps {eps} underflows double precision")


def _solve(df, batch, kept, eps, iters, source: _Measured, task_rows) -> DataFrame:
    task_rows = task_rows or rows_per_task(source.cells)
    # Sizes need the batch column alone.
    sizes = df.groupBy(batch).agg(F.count("*").alias("_rows"))
    large = materialize(sizes.where(F.col("_rows") > task_rows), "large-batches")
    count = large.count()
    if count == 0:
        discard(large)
        return _small_batches(df, batch, kept, eps, iters, source)
    names = large.select(batch)
    rest = df.join(F.broadcast(names) if count <= BROADCAST_NAMES else names, batch, "left_anti")
    solved = _small_batches(rest, batch, kept, eps, iters, source)
    at_once = max(1, min(BATCHES_AT_ONCE, WEIGHT_BYTES // (8 * source.codes)))
    if count <= at_once:
        return solved.unionByName(_large_batches(df, names, batch, kept, eps, iters, source))
    numbered = with_idx(names, [batch], "_number")
    for low in range(0, count, at_once):
        chosen = numbered.where(F.col("_number").between(low, low + at_once - 1)).select(batch)
        solved = solved.unionByName(_large_batches(df, chosen, batch, kept, eps, iters, source))
    return solved


def _result_schema(df: DataFrame, kept: list[str], source: _Measured) -> T.StructType:
    fields = [df.schema[c] for c in kept] + [T.StructField("code", T.IntegerType())]
    if source.left_over is not None:
        fields.append(T.StructField("residual", T.ArrayType(T.DoubleType())))
    return T.StructType(fields)


def _result(table, kept: list[str], source: _Measured, code: np.ndarray) -> list[pa.Array]:
    column = {name: table.column(i) for i, name in enumerate(table.schema.names)}
    out = [column[c] for c in kept] + [pa.array(code, pa.int32())]
    if source.left_over is not None:
        out.append(k.to_lists(source.left_over(column[source.column], code), pa.float64()))
    return out


def _small_batches(df: DataFrame, batch, kept, eps, iters, source: _Measured) -> DataFrame:
    schema = _result_schema(df, kept, source)
    names = schema.names

    def solve(table: pa.Table) -> pa.Table:
        code = k.balanced_codes(source.measure(table.column(source.column)), eps, iters)
        return pa.table(_result(table, kept, source, code), names=names)

    return df.groupBy(batch).applyInArrow(solve, schema)


def _large_batches(df: DataFrame, chosen, batch, kept, eps, iters, source: _Measured) -> DataFrame:
    """Rows of the ``chosen`` batches, of which there are at most BATCHES_AT_ONCE."""
    context = df.sparkSession.sparkContext
    schema = _result_schema(df, kept, source)
    rows = materialize(df.join(F.broadcast(chosen), batch, "left_semi").select(*kept, source.column), "large-rows")
    number = {row[0]: i for i, row in enumerate(chosen.collect())}
    numbers = context.broadcast(number)

    def split(table: pa.RecordBatch):
        """Number, places and distances of the rows of each batch in an Arrow batch."""
        coded = table.column(table.schema.get_field_index(batch)).dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False)
        column = table.column(table.schema.get_field_index(source.column))
        for i, name in enumerate(coded.dictionary.to_pylist()):
            at = np.flatnonzero(place == i)
            yield numbers.value[name], at, source.measure(column.take(pa.array(at)))

    def extremes(tables):
        found: dict[int, tuple[float, float]] = {}
        for table in tables:
            for one, _, d in split(table):
                low, high = found.get(one, (np.inf, -np.inf))
                found[one] = min(low, d.min()), max(high, d.max())
        if found:
            low, high = zip(*found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64())],
                names=["number", "low", "high"],
            )

    narrow = rows.select(batch, source.column)
    ends = narrow.mapInArrow(extremes, "number int, low double, high double").groupBy("number")
    ends = ends.agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    limits = context.broadcast({row.number: (row.low, row.high) for row in ends})
    weights = np.ones((len(number), source.codes))

    for _ in range(iters):
        shipped = context.broadcast(weights)

        def pulls(tables, shipped=shipped):
            sums: dict[int, np.ndarray] = {}
            for table in tables:
                for one, _, d in split(table):
                    kernel = k.balanced_kernel(d, *limits.value[one], eps)
                    sums[one] = sums.get(one, 0) + k.column_pull(kernel, shipped.value[one])
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(sums), pa.int32()),
                        k.to_lists(np.stack(list(sums.values())), pa.float64()),
                    ],
                    names=["number", "pull"],
                )

        partial = narrow.mapInArrow(pulls, "number int, pull array<double>")
        summed = partial.groupBy("number").agg(
            Summarizer.sum(array_to_vector("pull")).alias("pull")
        )
        weights = np.empty_like(weights)
        for row in summed.collect():
            weights[row.number] = k.next_weights(row.pull.toArray())
        shipped.unpersist()

    final = context.broadcast(weights)

    def choose(tables):
        for table in tables:
            code = np.empty(table.num_rows, dtype=np.int32)
            for one, at, d in split(table):
                kernel = k.balanced_kernel(d, *limits.value[one], eps)
                code[at] = k.heaviest(kernel * final.value[one])
            yield pa.RecordBatch.from_arrays(_result(table, kept, source, code), names=schema.names)

    solved = materialize(rows.mapInArrow(choose, schema), "solved")
    discard(rows)
    return solved


def assign_codes_balanced(
    df: DataFrame,
    codebook: DataFrame,
    batch: str,
    epsilons: list[float],
    key: str = "idx",
    vec: str = "embedding",
    iters: int = 50,
    task_rows: int | None = None,
) -> DataFrame:
    """Residual codes with balanced levels: ``(key, batch, code_0 .. code_{L-1})``.

    Level ``i`` is balanced within each batch where ``epsilons[i] > 0`` and takes
    the nearest codeword elsewhere, as the quantizer does while it is fitted. Every step
    hands on the residual, so no row is joined to its codeword.
    """
    current = df.select(key, batch, F.col(vec).alias("_rest"))
    names: list[str] = []
    written = None
    for level, eps in enumerate(epsilons):
        last = level == len(epsilons) - 1
        coded = sinkhorn_codes(
            current, codebook, batch, key, "_rest", level, eps, iters, task_rows, names, not last
        )
        names = [*names, f"code_{level}"]
        coded = coded.withColumnRenamed("code", names[-1])
        if not last:
            coded = coded.withColumnRenamed("residual", "_rest")
        written = current = materialize(coded, "balanced", replaces=written)
    return current.select(key, batch, *names)
