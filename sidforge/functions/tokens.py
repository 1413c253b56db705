"""Rendering and parsing of code tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One letter per level, the token form, and the digits inside it.
LEVEL_LETTERS = "abcde"
TOKEN = "<{letter}_{code}>"
TOKEN_DIGITS = "([0-9]+)>$"


def code_token_sql(level: int, code: str) -> str:
    if not 0 <= level < len(LEVEL_LETTERS):
        raise ValueError(f"level {level} has no letter; at most {len(LEVEL_LETTERS)} levels exist")
    head, tail = TOKEN.format(letter=LEVEL_LETTERS[level], code="|").split("|")
    return f"concat('{head}', cast({code} as string), '{tail}')"


def code_token(level: int, code: str) -> Column:
    """Code 17 of level 0 renders as ``<a_17>``."""
    return F.expr(code_token_sql(level, code))


def parse_code(token: str) -> Column:
    """The number inside a token."""
    return F.expr(f"cast(regexp_extract({token}, '{TOKEN_DIGITS}', 1) as int)")


def code_columns(df: DataFrame) -> list[str]:
    """Code columns in schema order."""
    return [c for c in df.columns if c.startswith("code_")]


def render_tokens(df: DataFrame, code_cols: list[str] | None = None) -> DataFrame:
    """Replace integer code columns by their tokens, level by position."""
    names = code_cols or code_columns(df)
    return df.withColumns({c: code_token(i, c) for i, c in enumerate(names)})


def sid(code_cols: list[str]) -> Column:
    """All tokens of a row joined in the given order."""
    return F.expr(f"concat({', '.join(code_cols)})")


def geo_sid(geohash: str | None, code_cols: list[str]) -> Column:
    """Geohash in angle brackets before the SID; a missing geohash leaves ``<>``."""
    place = f"coalesce({geohash}, '')" if geohash else "''"
    return F.expr(f"concat('<', {place}, '>', {', '.join(code_cols)})")
