"""Exact nearest codewords of a large codebook, by groups with distance bounds.

Codewords are gathered around group centres, with the largest distance of a member as a group's
radius. No codeword of a group is nearer to a vector than the vector's distance to the centre less
the radius. A vector is first compared with the group of its nearest centre; that gives a
distance to beat, and only groups whose bound does not exceed it are searched as well. The
codebook never travels whole: groups are packed into blocks, a vector goes once to each block that
holds a group it must search, and a block with many vectors is cut into parts, each with its own
copy of the block's codewords. So where bounds leave every group open, as in many dimensions, a
vector is copied for each block, not for each group. Only centres and radii, about the square root
of the number of codewords, reach every task.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.functions.vectors import sanitize
from sidforge.operators import kernels as k
from sidforge.operators import kmeans
from sidforge.operators.quantize import _one_level
from sidforge.session import materialize

PART_ROWS = 1 << 15  # vectors of a block that one task compares, fewer if they are wide
# Codewords of a block, and vectors of a part, as doubles.
BLOCK_BYTES = 16 << 20
# Distances that a task holds at one time.
GRID = 1 << 21
# Relative room for rounding in bounds; a bound that is too low costs time only.
SLACK = 1e-9
_NO_CODE = (1 << 31) - 1
_FOUND = "_row bigint, code int, distance double, compared bigint"


class Groups(NamedTuple):
    """Codewords ``(code, point, group, block)`` without repeats of lower codes, centres and
    radii, and which blocks hold words of which group."""

    words: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    inside: np.ndarray


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(k.distances(x, y))


def _pieces(batches, groups: int):
    """Slices of batches whose rows x groups fit GRID."""
    step = min(k.SLICE_ROWS, max(1, GRID // groups))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _layout(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of each group and the number of blocks it is cut into: about ``most`` words
    a block. Whole groups share blocks, a group of more than ``most`` words has its own."""
    pieces = np.maximum(1, -(-sizes // most))
    shared = np.where(pieces == 1, sizes, 0)
    blocks = max(1, -(-shared.sum() // most))
    before = np.cumsum(shared) - shared
    first = np.minimum(before * blocks // max(1, shared.sum()), blocks - 1)
    large = pieces > 1
    first[large] = blocks + np.cumsum(pieces[large]) - pieces[large]
    return first, pieces


def group_codewords(codebook: DataFrame, level: int = 0, groups: int | None = None, seed: int = 2024) -> Groups:
    """Groups of one level's codewords; about the square root of their number unless given."""
    book = _one_level(codebook, level).select(F.col("centroid").cast("array<double>").alias("point"), "code")
    points = materialize(book.groupBy("point").agg(F.min("code").alias("code"), F.lit(1).alias("weight")), "codewords")
    count = points.count()
    groups = min(count, groups or max(1, round(count**0.5)))
    centres = kmeans.fit_centres(points.select("point", "weight"), groups, 5, 1, seed).centres[0]
    spark = points.sparkSession
    shipped = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in _pieces(batches, groups):
            gaps = _gaps(k.to_matrix(batch.column(1)), shipped.value)
            group = gaps.argmin(axis=1)
            gap = gaps[np.arange(len(group)), group]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(group, pa.int32()), pa.array(gap)], ["code", "point", "group", "gap"]
            )

    words = points.select("code", "point").mapInArrow(assign, "code int, point array<double>, group int, gap double")
    words = materialize(words, "grouped", replaces=points)
    radii, sizes = np.zeros(groups), np.zeros(groups, np.int64)
    for row in words.groupBy("group").agg(F.max("gap").alias("r"), F.count("*").alias("n")).collect():  # a row per group
        radii[row.group], sizes[row.group] = row.r, row.n
    first, pieces = _layout(sizes, max(1, BLOCK_BYTES // (8 * max(1, centres.shape[1]))))
    inside = np.zeros((groups, int((first + pieces).max())), bool)
    for group in range(groups):
        inside[group, first[group] : first[group] + pieces[group]] = True
    places = spark.createDataFrame(
        [(g, int(f), int(p)) for g, (f, p) in enumerate(zip(first, pieces))], "group int, first int, pieces int"
    )
    block = F.expr("cast(first + pmod(xxhash64(code, point), pieces) as int)").alias("block")
    return Groups(words.join(F.broadcast(places), "group").select("code", "point", "group", block), centres, radii, inside)


def _search(rows: DataFrame, grouped: Groups, wanted) -> DataFrame:
    """``(_row, code, distance, compared)``, a row per vector and block, for ``rows`` (_row, x,
    group, beat). ``wanted(x, group, beat)`` masks the groups to search; only codewords that are
    as near as ``beat`` count."""
    spark = rows.sparkSession
    groups, width = grouped.centres.shape
    shipped = spark.sparkContext.broadcast(grouped.inside)

    def met(batches):
        """Pieces with their rows for each block."""
        inside = [np.flatnonzero(column) for column in shipped.value.T]
        for piece in _pieces(batches, groups):
            mask = wanted(k.to_matrix(piece.column(1)), piece.column(2).to_numpy(), piece.column(3).to_numpy())
            yield piece, [np.flatnonzero(mask[:, held].any(axis=1)) for held in inside]

    def count(batches):
        total = np.zeros(shipped.value.shape[1], np.int64)
        for _, found in met(batches):
            total += [len(at) for at in found]
        yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["block", "n"])

    parts = np.ones(grouped.inside.shape[1], np.int64)
    most = max(1, min(PART_ROWS, BLOCK_BYTES // (8 * max(1, width))))
    for row in rows.mapInArrow(count, "block int, n bigint").groupBy("block").agg(F.sum("n").alias("n")).collect():
        parts[row.block] = max(1, -(-row.n // most))  # a row per block

    def send(batches):
        for piece, found in met(batches):
            for block, at in enumerate(found):
                if len(at):
                    own = piece.take(pa.array(at))
                    part = own.column(0).to_numpy() % parts[block]
                    place = [pa.array(np.full(len(at), block, np.int32)), pa.array(part.astype(np.int32))]
                    yield pa.record_batch([*own.columns, *place], ["_row", "x", "group", "beat", "block", "part"])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({
            "_row": pa.array([], pa.int64()), "code": pa.array([], pa.int32()), "distance": pa.array([], pa.float64()),
            "compared": pa.array([], pa.int64()),
        })]
        if left.num_rows and right.num_rows:
            right = right.sort_by([("group", "ascending"), ("code", "ascending")])
            codes, book = right.column("code").to_numpy(), k.to_matrix(right.column("point"))
            held, starts = np.unique(right.column("group").to_numpy(), return_index=True)
            ends = [*starts[1:], len(codes)]
            for piece in _pieces([left.select(["_row", "x", "group", "beat"])], groups):
                x, beat = k.to_matrix(piece.column("x")), piece.column("beat").to_numpy()
                mask = wanted(x, piece.column("group").to_numpy(), beat)
                code, gap, compared = np.full(len(x), _NO_CODE, np.int64), np.full(len(x), np.inf), np.zeros(len(x), np.int64)
                for group, start, end in zip(held, starts, ends):
                    at = np.flatnonzero(mask[:, group])
                    compared[at] += end - start
                    step = max(1, GRID // (end - start))
                    for low in range(0, len(at), step):
                        _improve(x, at[low : low + step], book[start:end], codes[start:end], beat, code, gap)
                out.append(
                    pa.table({
                        "_row": piece.column("_row"), "code": pa.array(code, pa.int32()), "distance": pa.array(gap),
                        "compared": pa.array(compared),
                    })
                )
        return pa.concat_tables(out)

    sent = rows.mapInArrow(send, "_row bigint, x array<double>, group int, beat double, block int, part int")
    cut = spark.createDataFrame([(b, int(n)) for b, n in enumerate(parts)], "block int, parts int")
    words = grouped.words.join(F.broadcast(cut), "block").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    keys = ["block", "part"]
    both = sent.groupBy(*keys).cogroup(words.select(*keys, "code", "point", "group").groupBy(*keys))
    return both.applyInArrow(nearest, _FOUND)


def _improve(
    x: np.ndarray, at: np.ndarray, book: np.ndarray, codes: np.ndarray, beat: np.ndarray, code: np.ndarray, gap: np.ndarray
) -> None:
    """Compare rows ``at`` with a group's codewords and keep in ``code`` and ``gap`` what is nearer."""
    own = x[at]
    found, about = k.nearest(own, book, np.zeros(len(book), bool))
    room = SLACK * (np.square(own).sum(axis=1) + np.square(book).sum(axis=1).max())
    near = ~(about > np.minimum(gap[at], beat[at]) + room)
    at, own, found = at[near], own[near], found[near]
    # Measured directly, so that equal distances are equal in every task.
    measured = np.square(own - book[found]).sum(axis=1)
    better = (measured < gap[at]) | ((measured == gap[at]) & (codes[found] < code[at]))
    code[at[better]], gap[at[better]] = codes[found[better]], measured[better]


def nearest_by_groups(
    df: DataFrame, grouped: Groups, vec: str = "embedding", report: bool = False
) -> DataFrame:
    """Add ``code`` and ``distance`` of the nearest codeword, lowest code on ties; ``report`` adds
    ``compared``, the number of codewords that the vector was compared with.

    NaN, infinite and null elements count as 0; a null vector or one of another width stops
    the job.
    """
    shipped = df.sparkSession.sparkContext.broadcast((grouped.centres, grouped.radii))
    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select("_row", sanitize(vec).cast("array<double>").alias("x"))

    def home(batches):
        centres = shipped.value[0]
        for batch in _pieces(batches, len(centres)):
            x = k.clean_matrix(batch.column(1), centres.shape[1])
            group = _gaps(x, centres).argmin(axis=1)
            yield pa.record_batch(
                [*batch.columns, pa.array(group, pa.int32()), pa.array(np.full(len(x), np.inf))], ["_row", "x", "group", "beat"]
            )

    def own(x, group, beat):
        return group[:, None] == np.arange(len(shipped.value[0]))

    def others(x, group, beat):
        centres, radii = shipped.value
        gaps = _gaps(x, centres)
        reach = np.sqrt(beat) + SLACK * (gaps.max(axis=1) + 1)
        mask = gaps - radii <= reach[:, None]
        mask[np.arange(len(x)), group] = False
        return mask

    first_rows = rows.mapInArrow(home, "_row bigint, x array<double>, group int, beat double")
    first = materialize(_search(first_rows, grouped, own), "nearest")
    beats = first.groupBy("_row").agg(F.min("distance").alias("beat"))
    held = first_rows.drop("beat").join(beats, "_row").select("_row", "x", "group", "beat")
    second = _search(materialize(held, "homes"), grouped, others)
    best = first.unionByName(second).groupBy("_row").agg(
        F.min(F.struct("distance", "code")).alias("_best"), F.sum("compared").alias("compared")
    )
    found = numbered.join(best, "_row")
    extra = ["compared"] if report else []
    return found.select(*df.columns, F.col("_best.code").alias("code"), F.col("_best.distance").alias("distance"), *extra)


def groups_of(codebook: DataFrame, levels: int) -> list[Groups]:
    """Groups of every level."""
    return [group_codewords(codebook, level) for level in range(levels)]


def assign_by_groups(df: DataFrame, grouped: list[Groups], vec: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Residual codes ``code_0 ..`` with the groups of every level; columns in ``keep`` (default:
    all but the vector) stay. No level's codebook travels whole."""
    keep = [c for c in df.columns if c != vec] if keep is None else keep
    current = df.select(F.struct(*keep).alias("_kept"), sanitize(vec).cast("array<double>").alias("_rest"))
    codes: list[str] = []
    written = None
    for level, own in enumerate(grouped):
        found = nearest_by_groups(current, own, "_rest").drop("distance").withColumnRenamed("code", f"code_{level}")
        codes.append(f"code_{level}")
        if level + 1 < len(grouped):
            words = own.words.select(F.col("code").alias(codes[-1]), F.col("point").alias("_word"))
            left = F.expr("zip_with(_rest, _word, (v, w) -> v - w)").alias("_rest")
            found = found.join(words, codes[-1]).select("_kept", *codes, left)
        current = materialize(found, "codes", replaces=written)
        written = current
    return current.select("_kept.*", *codes)
