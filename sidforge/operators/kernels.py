"""Small numpy helpers that run inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Rows handled by one matrix product.
SLICE_ROWS = 4096
# Balanced weights closer than this share of the largest count as equal.
TIE_MARGIN = 1e-9


def to_matrix(column: pa.Array) -> np.ndarray:
    """A list column as an (n, width) double matrix; every list must be as wide."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError(f"{column.null_count} null vectors; clean the table first")
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if rows == 0:
        return np.zeros((0, 0))
    widths = np.diff(column.offsets.to_numpy())
    if not (widths == widths[0]).all():
        raise ValueError(f"ragged vectors, widths {widths.min()} to {widths.max()}")
    return flat.reshape(rows, widths[0]).astype(np.float64)


def clean_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as a matrix: NaN, infinite and null elements become 0, as in
    ``functions.vectors.sanitize``. A null vector or another width stops the job."""
    x = to_matrix(column)
    if width is not None and len(x) and x.shape[1] != width:
        raise ValueError(f"expected {width} elements, found {x.shape[1]}")
    x[~np.isfinite(x)] = 0.0
    return x


def to_lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An (n, width) matrix as a list column."""
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), type=kind))


def distances(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Squared distances between rows and codewords."""
    cross = x @ codebook.T
    gap = (x * x).sum(axis=1)[:, None] + (codebook * codebook).sum(axis=1)[None, :] - 2.0 * cross
    return np.maximum(gap, 0.0)


def first_copies(codebook: np.ndarray) -> np.ndarray:
    """Mask of codewords that repeat a lower code.

    Rounding may favour either copy in a matrix product, so repeats are taken
    out of the contest and the lowest code wins the tie.
    """
    _, first = np.unique(codebook, axis=0, return_index=True)
    repeats = np.ones(len(codebook), dtype=bool)
    repeats[first] = False
    return repeats


def nearest(x: np.ndarray, codebook: np.ndarray, repeats: np.ndarray):
    """Lowest nearest code of each row and its distance.

    The squared length of the row is the same for every codeword, so it joins
    only the winner.
    """
    gap = x @ (-2.0 * codebook.T)
    gap += (codebook * codebook).sum(axis=1)
    if repeats.any():
        gap[:, repeats] = np.inf
    code = gap.argmin(axis=1)
    best = gap[np.arange(len(x)), code] + np.einsum("ij,ij->i", x, x)
    return code, np.maximum(best, 0.0)


def residual_codes(x: np.ndarray, levels: list[np.ndarray], repeats: list[np.ndarray]):
    """Codes of every level, the residual left over, and squared error per level."""
    codes = np.empty((len(x), len(levels)), dtype=np.int32)
    errors = np.empty((len(x), len(levels)))
    rest = x
    for level, (book, skip) in enumerate(zip(levels, repeats)):
        codes[:, level], _ = nearest(rest, book, skip)
        rest = rest - book[codes[:, level]]
        errors[:, level] = np.einsum("ij,ij->i", rest, rest)
    return codes, rest, errors


def activate(name: str | None, x: np.ndarray) -> np.ndarray:
    """Elementwise activation by name."""
    key = (name or "none").lower()
    if key == "none":
        return x
    if key == "relu":
        return np.maximum(x, 0.0)
    if key == "leakyrelu":
        return np.where(x >= 0, x, 0.01 * x)
    if key == "tanh":
        return np.tanh(x)
    if key == "sigmoid":
        return 1.0 / (1.0 + np.exp(-x))
    raise ValueError(f"unknown activation {name!r}")


def balanced_kernel(d: np.ndarray, low: float, high: float, eps: float) -> np.ndarray:
    """``exp(-centred distance / eps)`` with each row scaled to a maximum of 1.

    Row scale cancels in the first row normalisation, and the scaled form
    cannot overflow.
    """
    middle = (high + low) / 2.0
    logits = -(d - middle) / (high - middle + 1e-5) / eps
    return np.exp(logits - logits.max(axis=1, keepdims=True))


def column_pull(kernel: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Column sums of the kernel after its rows are normalised under weights ``v``."""
    return (kernel / (kernel @ v)[:, None]).sum(axis=0)


def next_weights(pull: np.ndarray) -> np.ndarray:
    """Column weights that give every column the same mass, largest weight 1."""
    v = 1.0 / pull
    return v / v.max()


def heaviest(weights: np.ndarray) -> np.ndarray:
    """Lowest code among the largest weights of each row.

    A batch with fewer rows than codes leaves whole columns to one row, whose
    weights are then equal but for rounding. The margin keeps the choice
    independent of the order in which sums were taken.
    """
    top = weights.max(axis=1, keepdims=True)
    return (weights >= top * (1.0 - TIE_MARGIN)).argmax(axis=1)


def balanced_codes(d: np.ndarray, eps: float, iters: int) -> np.ndarray:
    """Balanced code of each row of one whole batch."""
    kernel = balanced_kernel(d, d.min(), d.max(), eps)
    v = np.ones(d.shape[1])
    for _ in range(iters):
        v = next_weights(column_pull(kernel, v))
    return heaviest(kernel * v)


def separate(
    d: np.ndarray, codes: np.ndarray, rounds: int, eps: float, iters: int
) -> np.ndarray:
    """Rebalance every set of rows sharing a code until none do or nothing moves."""
    codes = codes.copy()
    # The same members always get the same codes; rows that cannot separate
    # come back round after round.
    known: dict[bytes, np.ndarray] = {}
    for _ in range(rounds):
        used, size = np.unique(codes, return_counts=True)
        before = codes.copy()
        for code in used[size > 1]:
            members = np.flatnonzero(before == code)
            key = members.tobytes()
            if key not in known:
                known[key] = balanced_codes(d[members], eps, iters)
            codes[members] = known[key]
        if (codes == before).all():
            break
    return codes
