"""Geohash as a plain SQL expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidforge.functions.text import strip_sql

# The geohash alphabet, and the text forms accepted as a number
# (underscores may separate digits; words such as "nan" never give a cell).
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
NUMBER = r"^[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$"
MAX_PRECISION = 12


def to_number_sql(value: str) -> str:
    text = strip_sql(f"cast({value} as string)")
    return f"if({text} rlike r'{NUMBER}', try_cast(replace({text}, '_', '') as double), null)"


def _cell_sql(value: str, low: int, span: int, bits: int) -> str:
    """Index of the cell holding ``value``, null outside the range. A border
    belongs to the upper cell; the top edge belongs to the last."""
    cells = 1 << bits
    index = f"least(floor(({value} + {-low}D) / {span}D * {cells}D), {cells - 1}L)"
    return f"if({value} between {low}D and {low + span}D, {index}, null)"


def _letters_sql(column: str, row: str, lng_bits: int, lat_bits: int, precision: int) -> str:
    """Five bits per letter, taken from the cell indexes in turn, longitude first."""

    def bit(place: int) -> str:
        source, width = (column, lng_bits) if place % 2 == 0 else (row, lat_bits)
        return f"(shiftright({source}, {width - 1 - place // 2}) & 1)"

    letters = []
    for k in range(precision):
        digit = " + ".join(f"{1 << (4 - b)} * {bit(5 * k + b)}" for b in range(5))
        letters.append(f"substring('{ALPHABET}', cast({digit} as int) + 1, 1)")
    return f"concat({', '.join(letters)})"


def to_number(value: str) -> Column:
    """Double value of a text, null where it is not a number."""
    return F.expr(to_number_sql(value))


def with_geohash(
    df: DataFrame, out: str = "geohash", lng: str = "i_lng", lat: str = "i_lag", precision: int = 6
) -> DataFrame:
    """Add the geohash of a point, null when a coordinate is missing, not numeric
    or outside the globe.

    Three projections (numbers, cells, letters) that run in one generated stage.
    """
    if not 1 <= precision <= MAX_PRECISION:
        raise ValueError(f"precision {precision} is not within 1..{MAX_PRECISION}")
    lng_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    names = [f"`{c}`" for c in df.columns if c != out]
    numbers = df.selectExpr("*", f"{to_number_sql(lng)} as _lng", f"{to_number_sql(lat)} as _lat")
    cells = numbers.selectExpr(
        *names,
        f"{_cell_sql('_lng', -180, 360, lng_bits)} as _column",
        f"{_cell_sql('_lat', -90, 180, lat_bits)} as _row",
    )
    text = _letters_sql("_column", "_row", lng_bits, lat_bits, precision)
    return cells.selectExpr(*names, f"{text} as `{out}`")
