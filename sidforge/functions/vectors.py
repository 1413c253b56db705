"""Per-row vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A null element reads as NaN.
_BROKEN = "(x is null or isnan(x))"
_INFINITE = "(abs(x) = float('inf'))"


def sanitize(vec: str) -> Column:
    """NaN, infinite and null elements become 0."""
    return F.expr(f"transform({vec}, x -> if({_BROKEN} or {_INFINITE}, float(0), x))")


def checked(vec: str, dim: int) -> Column:
    """The vector, sanitized; a row that is null or of another width stops the job."""
    width = F.coalesce(F.size(vec), F.lit(-1))
    problem = F.concat(F.lit(f"expected {dim} elements, found "), width.cast("string"))
    return F.when(width == dim, sanitize(vec)).otherwise(
        F.raise_error(problem).cast("array<float>")
    )


def nan_count(vec: str) -> Column:
    return F.expr(f"size(filter({vec}, x -> {_BROKEN}))")


def inf_count(vec: str) -> Column:
    return F.expr(f"size(filter({vec}, x -> x is not null and {_INFINITE}))")


def total(vec: str) -> Column:
    return F.expr(f"aggregate({vec}, 0D, (acc, x) -> acc + x)")


def norm(vec: str) -> Column:
    return F.expr(f"sqrt(aggregate({vec}, 0D, (acc, x) -> acc + double(x) * double(x)))")


def add(vectors: list[str]) -> Column:
    """Elementwise sum, left to right."""
    text = vectors[0]
    for other in vectors[1:]:
        text = f"zip_with({text}, {other}, (a, b) -> a + b)"
    return F.expr(text)


def squared_gap(left: str, right: str) -> Column:
    gap = f"zip_with({left}, {right}, (a, b) -> double(a) - double(b))"
    return F.expr(f"aggregate({gap}, 0D, (acc, g) -> acc + g * g)")


def absolute_gap(left: str, right: str) -> Column:
    gap = f"zip_with({left}, {right}, (a, b) -> double(a) - double(b))"
    return F.expr(f"aggregate({gap}, 0D, (acc, g) -> acc + abs(g))")
