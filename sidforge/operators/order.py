"""Order statistics without a sort: radix selection on the ordered bits of doubles.

A double's bits, flipped so that they order as the numbers do, are read from the front in
DIGITS-bit digits. A pass counts the digits of those values that begin like a wanted one; the
counts tell the next digit of each wanted value. Tasks send counts only, at most 2^DIGITS for
each wanted value, so equal values cost nothing and no value is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.session import discard, materialize

DIGITS = 16
_SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of ``values``; -0.0 equals 0.0 and NaN comes last."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)  # one NaN, one zero
    bits = values.view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | _SIGN)


def value_of(key: int) -> float:
    """The double of one ordered integer."""
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digit_counts(values: DataFrame, prefixes: list[int], read: int) -> dict[tuple[int, int], int]:
    """How often each digit follows each prefix of ``read`` bits."""
    shift = np.uint64(64 - read - DIGITS)
    mask = np.uint64((1 << DIGITS) - 1)

    def count(batches):
        sums = np.zeros((len(prefixes), 1 << DIGITS), np.int64)
        for batch in batches:
            keys = ordered_bits(batch.column(0).to_numpy())
            weight = batch.column(1).to_numpy()
            for i, prefix in enumerate(prefixes):
                own = slice(None) if read == 0 else keys >> np.uint64(64 - read) == np.uint64(prefix)
                found = np.bincount((keys[own] >> shift & mask).astype(np.int64), weight[own], 1 << DIGITS)
                sums[i] += found.astype(np.int64)
        at, digit = np.nonzero(sums)
        yield pa.record_batch(
            [pa.array(at, pa.int64()), pa.array(digit, pa.int64()), pa.array(sums[at, digit])], ["at", "digit", "n"]
        )

    parts = values.mapInArrow(count, "at bigint, digit bigint, n bigint")
    met = parts.groupBy("at", "digit").agg(F.sum("n").alias("n")).collect()
    return {(prefixes[r["at"]], r.digit): r.n for r in met}


def select_places(values: DataFrame, places: list[int], weight: str | None = None) -> list[float]:
    """The values at 0-based ``places`` in the order of the first column of ``values``.

    Nulls do not count. ``weight`` names a column that says how often a value occurs. A place
    behind the last value is an error.
    """
    name = values.columns[0]
    times = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    # 16 bytes a row, read 64 / DIGITS times.
    written = materialize(values.where(F.col(name).isNotNull()).select(F.col(name).cast("double").alias("x"), times.alias("w")), "values")
    found = [(0, place) for place in places]  # prefix so far, place among its values
    for read in range(0, 64, DIGITS):
        counts = _digit_counts(written, sorted({p for p, _ in found}), read)
        following = {p: sorted((d, n) for (q, d), n in counts.items() if q == p) for p, _ in found}
        deeper = []
        for prefix, place in found:
            for digit, n in following[prefix]:
                if place < n:
                    deeper.append((prefix << DIGITS | digit, place))
                    break
                place -= n
            else:
                raise ValueError(f"no value at place {place}")
        found = deeper
    discard(written)
    return [value_of(key) for key, _ in found]


def quantiles(values: DataFrame, shares: list[float], weight: str | None = None) -> list[float | None]:
    """Quantiles of the first column, interpolated between neighbours; None without values."""
    column = F.col(values.columns[0])
    total = F.sum(F.when(column.isNotNull(), F.col(weight) if weight else F.lit(1)))
    n = values.agg(total.alias("n")).first().n or 0
    if not n:
        return [None] * len(shares)
    spots = [share * (n - 1) for share in shares]
    places = sorted({p for s in spots for p in (int(s), min(int(s) + 1, n - 1))})
    at = dict(zip(places, select_places(values, places, weight)))
    return [at[int(s)] + (at[min(int(s) + 1, n - 1)] - at[int(s)]) * (s - int(s)) if s > int(s) else at[int(s)] for s in spots]
