"""Residual quantization of vectors with a fitted codebook.

A codebook is a table ``(level int, code int, centroid array<double>)``. It is a
model parameter (levels x codes x width), not data, yet its size is checked:
codebooks within ``BROADCAST_BYTES`` ship whole to every task, larger ones are
searched block by block with the running best and its residual kept in the table.
Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidforge.functions.vectors import absolute_gap, add, squared_gap
from sidforge.operators import kernels as k
from sidforge.session import discard, materialize

BROADCAST_BYTES = 256 << 20


def codebook_bytes(codebook: DataFrame) -> int:
    return codebook.agg(F.sum(F.size("centroid") * F.lit(8))).first()[0] or 0


def fetch_levels(codebook: DataFrame, limit: int | None = None) -> list[np.ndarray] | None:
    """The codebook as one matrix per level, or ``None`` if it exceeds ``limit`` bytes."""
    if codebook_bytes(codebook) > (BROADCAST_BYTES if limit is None else limit):
        return None
    levels: dict[int, dict[int, list]] = {}
    for row in codebook.select("level", "code", "centroid").collect():
        levels.setdefault(row.level, {})[row.code] = row.centroid
    for level in range(len(levels)):
        book = levels.get(level, {})
        if not book or sorted(book) != list(range(len(book))):
            raise ValueError(f"codes of level {level} are not 0..K-1: {sorted(book)}")
    return [
        np.array([levels[i][c] for c in range(len(levels[i]))], dtype=np.float64)
        for i in range(len(levels))
    ]


def _one_level(codebook: DataFrame, level: int) -> DataFrame:
    return codebook.where(F.col("level") == level).withColumn("level", F.lit(0))


def _arrow_map(
    df: DataFrame, inputs: list[str], added: list[T.StructField], work, keep: list[str] | None = None
) -> DataFrame:
    """Append the columns ``work(batch)`` returns to those in ``keep`` (default: all
    ``inputs`` it does not replace). Only ``inputs`` travel to Python, only the
    result travels back."""
    part = df.select(*inputs)
    new = {a.name for a in added}
    kept = [f for f in part.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    schema = T.StructType(kept + added)
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, k.SLICE_ROWS):
                piece = batch.slice(start, k.SLICE_ROWS)
                columns = [piece.column(piece.schema.get_field_index(n)) for n in names]
                out = work(piece)
                yield pa.RecordBatch.from_arrays(
                    columns + list(out.values()), names=names + list(out)
                )

    return part.mapInArrow(run, schema)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _double_list(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.DoubleType()))


def _codeword_blocks(book: DataFrame, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """One level in blocks of at most ``limit`` bytes, at least a codeword each.

    Yields the first code, the codewords, and the mask of those that repeat a lower code of
    any block. Only one block is on the driver at a time.
    """
    first = book.groupBy("centroid").agg(F.min("code").alias("code"))
    marked = book.join(first.select("code", F.lit(True).alias("first")), "code", "left")
    marked = materialize(marked.select("code", "centroid", "first"), "blocks")
    shape = marked.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("dim")).first()
    size = max(1, limit // (8 * shape.dim))
    for low in range(0, shape.n, size):
        rows = marked.where(F.col("code").between(low, low + size - 1)).orderBy("code").collect()
        if [r.code for r in rows] != list(range(low, min(low + size, shape.n))):
            raise ValueError(f"codes are not 0..{shape.n - 1}")
        yield (
            low,
            np.array([r.centroid for r in rows], dtype=np.float64),
            np.array([r.first is None for r in rows]),
        )
    discard(marked)


def codebook_distances(
    df: DataFrame, codebook: DataFrame, level: int = 0, vec: str = "embedding",
    limit: int | None = None,
) -> DataFrame:
    """Add ``distances``: squared distance to every codeword of one level, by code.

    One array per row takes the place of a row per (vector, codeword) pair. Beyond ``limit``
    bytes the codewords come in blocks and the array grows block by block.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    book = _one_level(codebook, level)
    added = [_double_list("distances")]
    levels = fetch_levels(book, limit)
    context = df.sparkSession.sparkContext
    if levels is not None:
        shipped = context.broadcast(levels[0])

        def work(batch):
            words = shipped.value
            d = k.distances(k.clean_matrix(_column(batch, vec), words.shape[1]), words)
            return {"distances": k.to_lists(d, pa.float64())}

        return _arrow_map(df, df.columns, added, work)

    current = df.withColumn("distances", F.array().cast("array<double>"))
    previous = None
    for _, part, _ in _codeword_blocks(book, limit):
        shipped = context.broadcast(part)

        def extend(batch, shipped=shipped):
            words = shipped.value
            d = k.distances(k.clean_matrix(_column(batch, vec), words.shape[1]), words)
            both = np.hstack([k.to_matrix(_column(batch, "distances")), d])
            return {"distances": k.to_lists(both, pa.float64())}

        step = materialize(_arrow_map(current, current.columns, added, extend), "distances", previous)
        shipped.unpersist()
        current = previous = step
    return current.select(*df.columns, "distances")


def distance_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Long form of ``distances``: one row per vector and code."""
    return df.select(*key, F.posexplode("distances").alias("code", "distance"))


def nearest_code(
    df: DataFrame, codebook: DataFrame, level: int = 0, vec: str = "embedding",
    limit: int | None = None,
) -> DataFrame:
    """Add ``code`` and ``distance`` of the nearest codeword, lowest code on ties."""
    limit = BROADCAST_BYTES if limit is None else limit
    one = _one_level(codebook, level)
    added = [T.StructField("code", T.IntegerType()), T.StructField("distance", T.DoubleType())]
    levels = fetch_levels(one, limit)
    if levels is None:
        found = _nearest_in_blocks(df.withColumn("_rest", F.col(vec)), one, "_rest", limit)
        return found.select(*df.columns, "code", "distance")
    book = levels[0]
    shipped = df.sparkSession.sparkContext.broadcast((book, k.first_copies(book)))

    def work(batch):
        book, repeats = shipped.value
        code, gap = k.nearest(k.clean_matrix(_column(batch, vec), book.shape[1]), book, repeats)
        return {"code": pa.array(code, pa.int32()), "distance": pa.array(gap)}

    return _arrow_map(df, df.columns, added, work)


def _nearest_in_blocks(df: DataFrame, book: DataFrame, rest: str, limit: int) -> DataFrame:
    """Nearest code over a codebook too large to ship whole, with what it leaves as ``_left``.

    Each pass compares all rows with one block of codewords and keeps the better of the
    block's best and the best so far, and what that codeword leaves over of ``rest``. A later
    block holds higher codes, so only a strictly smaller distance replaces it.
    """
    added = [
        T.StructField("code", T.IntegerType()), T.StructField("distance", T.DoubleType()),
        _double_list("_left"),
    ]
    current = df.withColumns({
        "code": F.lit(-1), "distance": F.lit(float("inf")), "_left": F.col(rest).cast("array<double>"),
    })
    previous = None
    for low, part, repeats in _codeword_blocks(book, limit):
        if repeats.all():
            continue  # lower blocks hold the same codewords
        shipped = df.sparkSession.sparkContext.broadcast((part, repeats, low))

        def work(batch, shipped=shipped):
            part, repeats, low = shipped.value
            x = k.clean_matrix(_column(batch, rest), part.shape[1])
            code, gap = k.nearest(x, part, repeats)
            old_gap = _column(batch, "distance").to_numpy(zero_copy_only=False)
            old_code = _column(batch, "code").to_numpy(zero_copy_only=False)
            better = (gap < old_gap) | (old_code < 0)
            left = np.where(better[:, None], x - part[code], k.clean_matrix(_column(batch, "_left")))
            return {
                "code": pa.array(np.where(better, code + low, old_code), pa.int32()),
                "distance": pa.array(np.where(better, gap, old_gap)),
                "_left": k.to_lists(left, pa.float64()),
            }

        step = materialize(_arrow_map(current, current.columns, added, work), "nearest", previous)
        shipped.unpersist()
        current = previous = step
    return current


def assign_codes(
    df: DataFrame,
    codebook: DataFrame,
    vec: str = "embedding",
    keep: list[str] | None = None,
    errors: bool = False,
    residual: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Add ``code_0 .. code_{L-1}``: nearest codeword of what earlier levels left over.

    All levels run in one Arrow pass. ``keep`` lists the columns to carry
    (default: all but the vector). ``errors`` adds the squared error after each
    level, ``residual`` the vector that remains. NaN, infinite and null elements
    count as 0; a null vector or one of another width stops the job.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    keep = [c for c in df.columns if c != vec] if keep is None else keep
    levels = fetch_levels(codebook, limit)
    if levels is None:
        return _assign_level_by_level(df, codebook, vec, keep, errors, residual, limit)
    shipped = df.sparkSession.sparkContext.broadcast((levels, [k.first_copies(b) for b in levels]))
    codes = [T.StructField(f"code_{i}", T.IntegerType()) for i in range(len(levels))]
    extra = [_double_list("errors")] * errors + [_double_list("residual")] * residual

    def work(batch):
        books, repeats = shipped.value
        x = k.clean_matrix(_column(batch, vec), books[0].shape[1])
        found, rest, err = k.residual_codes(x, books, repeats)
        out = {f"code_{i}": pa.array(found[:, i], pa.int32()) for i in range(found.shape[1])}
        if errors:
            out["errors"] = k.to_lists(err, pa.float64())
        if residual:
            out["residual"] = k.to_lists(rest, pa.float64())
        return out

    inputs = keep if vec in keep else [*keep, vec]
    coded = _arrow_map(df, inputs, codes + extra, work, keep)
    return coded.select(*keep, *[f.name for f in codes + extra])


def _assign_level_by_level(df, codebook, vec, keep, errors, residual, limit) -> DataFrame:
    """Assignment with a codebook beyond the broadcast limit: the residual travels with the
    best code, so no row is joined to its codeword."""
    levels = codebook.agg(F.max("level")).first()[0] + 1
    source = [c for c in keep if c != vec]
    current = df.select(
        *[F.col(c) for c in source], *([F.col(vec).alias("_vector")] if vec in keep else []),
        F.col(vec).cast("array<double>").alias("_rest"),
        F.array().cast("array<double>").alias("errors"),
    )
    square = "aggregate(_left, 0D, (acc, x) -> acc + x * x)"
    written = None
    for level in range(levels):
        found = _nearest_in_blocks(current, _one_level(codebook, level), "_rest", limit)
        if written is not None:
            discard(written)
        written = found
        current = (
            found.withColumn("errors", F.concat("errors", F.array(F.expr(square))))
            .withColumnRenamed("code", f"code_{level}")
            .drop("_rest", "distance")
            .withColumnRenamed("_left", "_rest")
        )
    names = [f"code_{i}" for i in range(levels)]
    extra = ["errors"] * errors + [F.col("_rest").alias("residual")] * residual
    kept = [F.col("_vector").alias(vec) if c == vec else F.col(c) for c in keep]
    return current.select(*kept, *names, *extra)


def decode(
    df: DataFrame, codebook: DataFrame, out: str = "reconstruction", limit: int | None = None
) -> DataFrame:
    """Add the sum of the codewords named by the code columns, null for a null code.

    One broadcast lookup per level, or a pass per block of codewords where the codebook is
    larger than ``limit`` bytes. A code outside the codebook stops the job.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    columns = df.columns
    # The codebook names the levels: further code columns, such as a rank, have no codewords.
    levels = [r.level for r in codebook.select("level").distinct().sort("level").collect()]
    if codebook_bytes(codebook) > limit:
        return _decode_in_blocks(df, codebook, levels, out, limit)
    current = df
    for level in levels:
        name = f"code_{level}"
        words = codebook.where(F.col("level") == level).select(
            F.col("code").alias(name), F.col("centroid").alias(f"_word_{level}")
        )
        current = current.join(F.broadcast(words), name, "left")
        unknown = _unknown_code(name).cast("array<double>")
        word = F.coalesce(f"_word_{level}", F.when(F.col(name).isNotNull(), unknown))
        current = current.withColumn(f"_word_{level}", word)
    total = add([f"_word_{level}" for level in levels])
    return current.select(*columns, total.alias(out))


def _unknown_code(name: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{name} outside the codebook: "), F.col(name).cast("string")))


def _decode_in_blocks(df, codebook, levels, out, limit) -> DataFrame:
    """Decoding with a codebook beyond the broadcast limit: each pass adds one block's words."""
    dim = codebook.agg(F.max(F.size("centroid"))).first()[0]
    names = [f"code_{level}" for level in levels]
    current = df.withColumn(out, F.array_repeat(F.lit(0.0), dim))
    for level, n in codebook.groupBy("level").count().collect():
        name = f"code_{level}"
        known = F.col(name).isNull() | F.col(name).between(0, n - 1)
        current = current.withColumn(name, F.when(known, F.col(name)).otherwise(_unknown_code(name).cast("int")))
    previous = None
    for level, name in zip(levels, names):
        for low, part, _ in _codeword_blocks(_one_level(codebook, level), limit):
            shipped = df.sparkSession.sparkContext.broadcast((part, low))

            def work(batch, shipped=shipped, name=name):
                part, low = shipped.value
                code = pc.fill_null(_column(batch, name), -1).to_numpy(zero_copy_only=False) - low
                here = (code >= 0) & (code < len(part))
                total = k.to_matrix(_column(batch, out))
                total[here] += part[code[here]]
                return {out: k.to_lists(total, pa.float64())}

            step = materialize(
                _arrow_map(current, current.columns, [_double_list(out)], work), "decoded", previous
            )
            shipped.unpersist()
            current = previous = step
    whole = reduce(and_, (F.col(name).isNotNull() for name in names))
    return current.withColumn(out, F.when(whole, F.col(out))).select(*df.columns, out)


def quant_loss(
    df: DataFrame, codebook: DataFrame, vec: str = "embedding", beta: float = 0.25
) -> DataFrame:
    """Per level: mean squared error and level loss ``(1 + beta) * mse``; the
    mean of the level losses is repeated on each row."""
    coded = assign_codes(df, codebook, vec, keep=[vec], errors=True)
    sums = coded.select(F.size(vec).alias("dim"), F.posexplode("errors").alias("level", "error"))
    per_level = sums.groupBy("level").agg((F.sum("error") / F.sum("dim")).alias("mse"))
    loss = per_level.withColumn("loss", F.col("mse") * F.lit(1.0 + beta))
    # One row per level from here on.
    return loss.withColumn("mean_loss", F.avg("loss").over(W.partitionBy(F.lit(0))))


def recon_loss(
    df: DataFrame,
    vec: str,
    reconstruction: str,
    kind: str = "mse",
    quant: float = 0.0,
    weight: float = 1.0,
) -> DataFrame:
    """One row: mean element error (``mse`` or ``l1``) and total with ``weight * quant``."""
    gaps = {"mse": squared_gap, "l1": absolute_gap}
    if kind not in gaps:
        raise ValueError(f"unknown loss {kind!r}")
    gap = gaps[kind](vec, reconstruction)
    recon = F.sum(gap) / F.sum(F.size(vec))
    return df.agg(recon.alias("recon")).select(
        F.lit(kind).alias("kind"), "recon", (F.col("recon") + F.lit(weight * quant)).alias("total")
    )


def group_means(df: DataFrame, keys: list[str], vec: str, out: str = "centroid") -> DataFrame:
    """Mean vector per group, summed on the map side before the shuffle."""
    vector = array_to_vector(F.col(vec).cast("array<double>"))
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.mean(vector)).alias(out))


def lloyd_step(
    df: DataFrame, codebook: DataFrame, level: int = 0, vec: str = "embedding"
) -> DataFrame:
    """One k-means update of a level; a codeword nobody chose stays where it is."""
    chosen = nearest_code(df.select(vec), codebook, level, vec)
    means = group_means(chosen, ["code"], vec, "_mean")
    old = codebook.where(F.col("level") == level)
    return old.join(means, "code", "left").select(
        "level", "code", F.coalesce("_mean", "centroid").alias("centroid")
    )
