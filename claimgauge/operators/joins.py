"""Joins on group keys that may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys``, where a null key equals a null key; the keys appear once."""
    renamed = right.withColumnsRenamed({key: f"right_{key}" for key in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"right_{key}" for key in keys])
