"""Joins whose probe side may hold one key in a third of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is looked up by broadcast. At most rows / HOT_ROWS
# keys qualify, which bounds the broadcast.
HOT_ROWS = 1 << 20


def join_counted(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    count: str = "n",
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` to ``lookup``, which has one row per key and the number of
    ``rows`` under it in ``count``.

    Rows of hot keys meet their lookup row where they are; only the others are
    shuffled, and no key among them exceeds ``hot_rows``. Without hot keys the
    first branch is empty and drops out at run time.
    """
    hot = lookup.where(F.col(count) > hot_rows)
    cold = lookup.where(F.col(count) <= hot_rows)
    direct = rows.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner")
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return direct.unionByName(others.join(cold, keys, how))
