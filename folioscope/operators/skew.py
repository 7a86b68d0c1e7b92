"""Joins with one row per group, where a group may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups`` by ``key``, which is never null; ``size`` is how many of ``total`` rows a group has.

    Groups of more than a thousandth of all rows, and of more than a thousand, are a thousand at most: they are
    broadcast, and their rows stay where they are.  The rows of all others are dealt by their key.
    """
    large = F.col(size) > max(1000, total // 1000)
    hot, rest = groups.where(large).drop(size), groups.where(~large).drop(size)
    near = rows.join(F.broadcast(hot), key)  # 1000 rows at most
    return near.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))
