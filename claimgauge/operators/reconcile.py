"""Checks across tables: appended batches, procedure codes between stages, spend concentration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from claimgauge.functions import money
from claimgauge.functions.ratios import ratio
from claimgauge.operators.order_stats import select_ranks


def append_claims(claims: DataFrame, batch: DataFrame) -> DataFrame:
    """Both tables' rows, columns matched by name."""
    return claims.unionByName(batch)


def code_reconciliation(stages: dict[str, DataFrame]) -> DataFrame:
    """Per stage, in the given order: rows, distinct and null codes, and codes lost or gained.

    The first stage is the base of the comparison. Every stage is reduced to its distinct codes
    before stages meet. A null code counts as one distinct code.
    """
    names = list(stages)
    by_code = reduce(
        DataFrame.unionByName,
        [
            stages[name].groupBy("procedure_code").agg(F.count("*").alias("n")).withColumn("stage", F.lit(i))
            for i, name in enumerate(names)
        ],
    )
    wide = by_code.groupBy("procedure_code").agg(
        *[F.sum(F.when(F.col("stage") == i, F.col("n"))).alias(f"n{i}") for i in range(len(names))]
    )
    in_base = F.col("n0").isNotNull()
    per_stage = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"), F.col(f"n{i}").alias("n"))
            for i, name in enumerate(names)
        ]
    )
    here = F.col("s.n").isNotNull()
    return (
        wide.select("procedure_code", in_base.alias("in_base"), F.explode(per_stage).alias("s"))
        .groupBy("s.position", "s.stage")
        .agg(
            F.coalesce(F.sum("s.n"), F.lit(0)).alias("total_rows"),
            F.count_if(here).alias("unique_codes"),
            F.coalesce(F.sum(F.when(F.col("procedure_code").isNull(), F.col("s.n"))), F.lit(0)).alias("null_codes"),
            F.count_if(F.col("in_base") & ~here).alias("dropped_codes"),
            F.count_if(~F.col("in_base") & here).alias("added_codes"),
        )
        .orderBy("position")
        .drop("position")
    )


def concentration_share(claims: DataFrame, amount: str = "billed_amount", top: float = 0.2) -> DataFrame:
    """One row: the share of the total amount held by the most expensive ``top`` of the claims.

    The smallest amount among the top claims is found by rank; everything above it is summed and
    ties at the cut are added as often as the rank allows, so nothing is sorted globally.
    """
    cut = select_ranks(claims, [], amount, {"cut": lambda n: n - F.floor(n * top) + 1})
    marked = claims.where(F.col(amount).isNotNull()).withColumn("cut", cut.select("cut").scalar())
    summed = (
        marked.withColumn("above", F.when(F.col(amount) > F.col("cut"), F.col(amount)))
        .agg(
            F.count("*").alias("n"),
            F.first("cut").alias("cut"),
            F.count("above").alias("n_above"),
            *money.sum_parts("above", "above"),
            *money.sum_parts(amount, "all"),
        )
    )
    n_top = F.floor(F.col("n") * top)
    top_amount = money.total("above") + F.coalesce(F.col("cut"), F.lit(0.0)) * (n_top - F.col("n_above"))
    return summed.select(
        F.col("n").alias("total_claims"),
        n_top.alias("top_claims"),
        F.round(ratio(top_amount, money.total("all")), 6).alias("top_share"),
    )
