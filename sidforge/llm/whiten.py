"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers x = floor(SCALE * c) + OFFSET, saturating at +-2^62. The fit list holds
each distinct integer vector once: n vectors with sums S. Centred rows are (n * x - S) / n, with
an exact numerator.

The bidiagonalisation runs in block form: every pass over the fit list multiplies WIDTH vectors
at once. U = X W is never stored: a task makes the rows of X v it needs, multiplies them by its
rows of X, and only sums of width x WIDTH numbers leave it. New directions on both sides are
reorthogonalised against all earlier ones; a block of U that was badly conditioned is measured
and orthogonalised a second time. The recurrence goes on, with fresh random directions where
it breaks down, until it spans all dimensions, so repeated eigenvalues are not missed: about
width / WIDTH passes. The SVD of the small block-bidiagonal matrix U'XV gives components and
deviations.

Rows whose vector is null or has null or non-finite entries are left out, and so are rows whose
width is not the most frequent one (the larger of equally frequent ones). Components without
variance (rank deficiency; a single distinct vector) are left out: they cannot be whitened. An
empty table gives no rows. A deviation beyond 64 bits is null. Repeated rows and ids are rows of their own.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.llm.common import schema_of
from sidforge.session import discard, materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
WIDTH = 16  # vectors multiplied in one pass
BLOCK_ROWS = 4096
BLOCK_NUMBERS = 1 << 20  # of one block at most, whatever the width
LEAST_VARIANCE = 1e-14  # of the whole; less cannot be told from rounding
_LIMIT = float(1 << 62)


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray  # S, int64
    components: np.ndarray  # width x k
    eigenvalues: np.ndarray  # k, falling
    explained: np.ndarray  # k
    identity_error: float


def integers(values: np.ndarray) -> np.ndarray:
    """Entries as integers; beyond 64 bits they saturate."""
    return np.clip(np.floor(SCALE * values), -_LIMIT, _LIMIT).astype(np.int64) + OFFSET


def _sound(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """Rows of finite vectors, of one width if it is given."""
    # A null vector fails each test; so does a null element, as NaN.
    finite = F.expr("forall(embedding, c -> coalesce(abs(c) < double('inf'), false))")
    rows = vectors.where(finite & F.expr("size(embedding) > 0"))
    return rows if width is None else rows.where(F.size("embedding") == width)


def _matrix(column: pa.ListArray, width: int, kind) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(-1, width)


def _blocks(vectors: DataFrame, width: int) -> DataFrame:
    """The fit list, packed into ``(x binary)`` blocks of int64 rows."""
    scaled = f"transform(embedding, c -> floor(greatest(least({SCALE} * double(c), {_LIMIT}), -{_LIMIT})) + {OFFSET})"
    distinct = vectors.select(F.expr(scaled).alias("x")).distinct()
    rows = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // width))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(_matrix(batch.column("x"), width, np.int64))
            size += batch.num_rows
            if size >= rows:
                x = np.concatenate(held)
                cut = size - size % rows
                parts = [x[i : i + rows].tobytes() for i in range(0, cut, rows)]
                yield pa.record_batch([pa.array(parts, pa.binary())], ["x"])
                held, size = [x[cut:]], size - cut
        if size:
            yield pa.record_batch([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["x"])

    return materialize(distinct.mapInArrow(run, "x binary"), "fit-list")


def _summed(blocks: DataFrame, part, kind: str = "double") -> np.ndarray:
    """Sum of ``part(block)``, an array of one shape, over all blocks.

    A task adds up its own blocks; the sums of tasks meet by position.
    """

    def run(batches):
        total = None
        for batch in batches:
            for data in batch.column("x"):
                found = part(np.frombuffer(data.as_buffer(), np.int64))
                total = found if total is None else total + found
        if total is not None:
            n = len(total)
            yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], ["at", "v"])

    sums = blocks.mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(sums)])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n * x - S) / n with an exact numerator where 64 bits hold it."""
    x = x.reshape(-1, len(sums))
    if n * max(abs(int(x.max())), abs(int(x.min()))) < 1 << 62:
        return (n * x - sums) / n
    return ((n * x.astype(object) - sums.astype(object)) / n).astype(float)


def _independent(block: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal directions of a block's columns, without those shorter than ``least``."""
    left, lengths, _ = np.linalg.svd(block, full_matrices=False)
    return left[:, lengths > least]


def fit(vectors: DataFrame, components: int = COMPONENTS, width: int = WIDTH) -> Whitening | None:
    """Components of the fit list of ``vectors`` (embedding); None without any variance."""
    sizes = _sound(vectors).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    d = sizes.d
    blocks = _blocks(_sound(vectors, d), d)
    try:
        return _fit(blocks, d, components, width)
    finally:
        discard(blocks)


def _fit(blocks: DataFrame, d: int, components: int, width: int) -> Whitening | None:
    totals = _summed(blocks, lambda x: np.append(x.reshape(-1, d).sum(axis=0), len(x) // d), "bigint")
    sums, n = totals[:-1].astype(np.int64), int(totals[-1])

    def products(w: np.ndarray) -> np.ndarray:
        """X'(Xw): u = Xw is made row by row and used at once."""

        def part(x):
            rows = _centred(x, n, sums)
            return (rows.T @ (rows @ w)).ravel()

        return _summed(blocks, part).reshape(d, w.shape[1])

    trace = _summed(blocks, lambda x: np.array([np.square(_centred(x, n, sums)).sum()]))[0]
    if trace == 0:
        return None
    rng = np.random.default_rng(13)
    none = np.zeros((d, 0))
    right, left, images = none, none, none  # V; W with U = XW; X'U
    fresh = np.linalg.qr(rng.standard_normal((d, min(width, d))))[0]
    while True:
        w = fresh
        right = np.hstack([right, fresh])
        least = LEAST_VARIANCE * trace
        for _ in range(3):
            g = products(w)
            # Against all earlier u: U'(Xw) = W'(X'Xw).
            for _ in range(2):
                back = left.T @ g
                w, g = w - left @ back, g - images @ back
            values, turn = np.linalg.eigh((w.T @ g + g.T @ w) / 2)
            held = values > least
            values, turn = values[held], turn[:, held]
            w, g = w @ turn / np.sqrt(values), g @ turn / np.sqrt(values)
            if not len(values) or values[-1] < 100 * values[0]:
                break
            least = 1e-3  # of unit vectors; what was rounding only is shorter when measured again
        left, images = np.hstack([left, w]), np.hstack([images, g])
        if right.shape[1] == d:
            break
        rest = g  # X'u
        for _ in range(2):
            rest = rest - right @ (right.T @ rest)
        fresh = _independent(rest, 1e-10 * np.sqrt(trace))
        room = min(width, d - right.shape[1])
        if fresh.shape[1] < room:  # broken down: go on in a direction not seen so far
            more = np.hstack([fresh, rng.standard_normal((d, room - fresh.shape[1]))])
            for _ in range(2):
                more = more - right @ (right.T @ more)
                more = np.linalg.qr(more)[0]
            fresh = more
        fresh = fresh[:, :room]
        fresh = np.linalg.qr(fresh - right @ (right.T @ fresh))[0]

    # X = U B V' with B = U'XV, block-bidiagonal.
    _, deviations, turned = np.linalg.svd(images.T @ right, full_matrices=False)
    held = np.square(deviations) > LEAST_VARIANCE * trace
    k = min(components, int(held.sum()))
    found, eigenvalues = right @ turned[:k].T, np.square(deviations[:k]) / n
    found /= np.linalg.norm(found, axis=0)
    scaled = found / np.sqrt(eigenvalues)

    def part(x):
        z = _centred(x, n, sums) @ scaled
        return np.append((z.T @ z).ravel(), z.sum(axis=0))

    total = _summed(blocks, part) / n
    means = total[k * k :]
    covariance = total[: k * k].reshape(k, k) - np.outer(means, means)
    error = float(np.abs(covariance - np.eye(k)).max())
    return Whitening(n, sums, found, eigenvalues, eigenvalues / (trace / n), error)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n * x - S)^2 of each row, exact; None beyond 64 bits."""
    if n * (float(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        gaps = n * x - sums
        if len(sums) * float(np.abs(gaps).max(initial=0)) ** 2 < 1 << 62:
            return np.square(gaps).sum(axis=1).tolist()
    exact = np.square(n * x.astype(object) - sums.astype(object)).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, keep: list[str], components: int = COMPONENTS) -> DataFrame:
    """The columns in ``keep`` with ``component, n, deviation, whitened, explained,
    identity_error``: one row per sound row and component."""
    added = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = vectors.select(F.struct(*keep).alias("_row"), "embedding")
    schema = schema_of(rows.select("_row")) + ", " + added
    names = [c.split()[0] for c in added.split(", ")]
    fitted = fit(vectors.select("embedding"), components)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema).select("_row.*", *names)
    n, sums = fitted.n, fitted.sums
    d, k = fitted.components.shape
    scaled = fitted.components / np.sqrt(fitted.eigenvalues)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(_matrix(batch.column("embedding"), d, np.float64))
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch(
                [
                    batch.column("_row").take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(at),
                    pa.array((_centred(x, n, sums) @ scaled).ravel()),
                    pa.array(np.tile(fitted.explained, m)),
                    pa.array(np.full(m * k, fitted.identity_error)),
                ],
                ["_row", *names],
            )

    return _sound(rows, d).mapInArrow(run, schema).select("_row.*", *names)
