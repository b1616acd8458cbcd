"""Exact sums of currency amounts.

A sum of doubles depends on the order in which partitions arrive, and a sum of decimals builds
an object per row. Here each amount is split into whole units and millionths, both of which are
summed as integers: the result is the same for every partitioning and every retry. Amounts are
taken to six decimal places. Amounts that are not a number, infinite or beyond ``LARGEST`` are summed
as doubles beside them; if there are any, the total is what adding them gives: not a number stays not a
number, and infinity stays infinite.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

MICRO = 1_000_000
#: Amounts up to here are summed as integers; larger doubles have no cents left.
LARGEST = 1e15


def sum_parts(amount: str, prefix: str) -> list[Column]:
    """Aggregates ``<prefix>_whole``, ``<prefix>_micro`` and ``<prefix>_odd`` of a double column."""
    regular = F.abs(F.col(amount)) <= LARGEST
    value = F.when(regular, F.col(amount))
    whole = F.floor(value)
    micro = F.floor((value - whole) * MICRO + 0.5)
    return [
        F.coalesce(F.sum(whole), F.lit(0)).alias(f"{prefix}_whole"),
        F.coalesce(F.sum(micro), F.lit(0)).alias(f"{prefix}_micro"),
        F.sum(F.when(~regular, F.col(amount))).alias(f"{prefix}_odd"),
    ]


def merge_parts(prefix: str) -> list[Column]:
    """Aggregates that add up parts made by :func:`sum_parts` at a finer grain."""
    return [
        *[F.coalesce(F.sum(f"{prefix}_{part}"), F.lit(0)).alias(f"{prefix}_{part}") for part in ("whole", "micro")],
        F.sum(f"{prefix}_odd").alias(f"{prefix}_odd"),
    ]


def total(prefix: str) -> Column:
    """The amount held by the parts, as a double."""
    whole = F.col(f"{prefix}_whole").cast("decimal(20,0)")
    micro = F.col(f"{prefix}_micro").cast("decimal(20,0)") * F.lit(Decimal("0.000001"))
    return (whole + micro).cast("double") + F.coalesce(F.col(f"{prefix}_odd"), F.lit(0.0))
