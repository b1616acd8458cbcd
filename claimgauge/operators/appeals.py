"""Denials, appeals and grievances."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimgauge.config import DEFAULT_COST_PER_APPEAL
from claimgauge.functions import money
from claimgauge.functions.ratios import count_where, rate

NO_REASON = "unknown"


def _denied(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("denial_flag") == "Y")


def appeals_funnel(claims: DataFrame, cost_per_appeal: float = DEFAULT_COST_PER_APPEAL) -> DataFrame:
    """One row: counts, denial rate, appeals per denial, and what the appeals cost.

    All appeals count, also those of claims that were not denied.
    """
    counted = claims.agg(
        F.count("*").alias("total_claims"),
        count_where(F.col("denial_flag") == "Y").alias("total_denials"),
        count_where(F.col("appeal_flag") == "Y").alias("total_appeals"),
        count_where(F.col("grievance_flag") == "Y").alias("total_grievances"),
    )
    return counted.select(
        "*",
        F.round(rate(F.col("total_denials"), F.col("total_claims")), 4).alias("overall_denial_rate"),
        F.round(rate(F.col("total_appeals"), F.col("total_denials")), 4).alias("overall_appeal_rate"),
        F.round(F.col("total_appeals") * cost_per_appeal, 2).alias("estimated_admin_cost"),
    )


def denial_categories(claims: DataFrame) -> DataFrame:
    """Denied claims by reason, most denials first; claims without a reason are left out."""
    return (
        _denied(claims)
        .where(F.col("denial_reason_category").isNotNull())
        .groupBy(F.col("denial_reason_category").alias("category"))
        .agg(
            F.count("*").alias("denial_count"),
            count_where(F.col("appeal_flag") == "Y").alias("appeal_count"),
            count_where(F.col("grievance_flag") == "Y").alias("grievance_count"),
            *money.sum_parts("billed_amount", "billed"),
            *money.sum_parts("allowed_amount", "allowed"),
        )
        .select(
            "category",
            "denial_count",
            "appeal_count",
            F.round(rate(F.col("appeal_count"), F.col("denial_count")), 4).alias("appeal_rate"),
            "grievance_count",
            F.round(money.total("billed"), 2).alias("total_billed"),
            F.round(money.total("allowed"), 2).alias("total_allowed"),
        )
        .orderBy(F.desc("denial_count"), "category")
    )


def top_denial_categories(claims: DataFrame, n: int = 5) -> DataFrame:
    return denial_categories(claims).limit(n)


def provider_appeals(claims: DataFrame) -> DataFrame:
    """Denied claims by provider with the most frequent reason, the first in order on a tie.

    Claims are first counted per provider and reason, so the second step only sees a handful of
    rows per provider, however many claims one provider holds.
    """
    by_reason = (
        _denied(claims)
        .groupBy("provider_id", F.coalesce("denial_reason_category", F.lit(NO_REASON)).alias("reason"))
        .agg(
            F.count("*").alias("n"),
            count_where(F.col("appeal_flag") == "Y").alias("appeals"),
            *money.sum_parts("billed_amount", "billed"),
        )
    )
    return (
        by_reason.groupBy("provider_id")
        .agg(
            F.sum("n").alias("total_denials"),
            F.sum("appeals").alias("total_appeals"),
            F.min(F.struct((-F.col("n")).alias("order"), "reason"))["reason"].alias("top_denial_reason"),
            *money.merge_parts("billed"),
        )
        .select(
            "provider_id",
            "total_denials",
            "total_appeals",
            F.round(rate(F.col("total_appeals"), F.col("total_denials")), 4).alias("appeal_rate"),
            "top_denial_reason",
            F.round(money.total("billed"), 2).alias("total_billed_denied"),
        )
    )


def top_appeal_providers(claims: DataFrame, n: int = 10) -> DataFrame:
    """The providers with the most appeals."""
    return provider_appeals(claims).orderBy(F.desc("total_appeals"), "provider_id").limit(n)
