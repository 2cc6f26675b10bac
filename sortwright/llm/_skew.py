"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with at least one in so many of all rows are hot, so there are at most so many hot keys.
SHARE = 1000


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a side that has one row for each key and in ``n`` how many rows carry it.

    Hot keys, at most ``SHARE`` of them by their counts, are joined by broadcast where the rows are; the
    others by shuffle. how: inner or left. Keys that are null find no partner.
    """
    bound = max(SHARE, total // SHARE + 1)
    hot = side.where(F.col(n) >= bound)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.where(F.col(n) < bound), keys, how)
    return near.unionByName(far)
