"""Provider, period and service-category features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimgauge.functions import money
from claimgauge.functions.codes import service_category
from claimgauge.functions.ratios import count_where, ratio

ROLLING_PERIODS = {"weekly": 4, "monthly": 3}


def tag_service_category(claims: DataFrame) -> DataFrame:
    """Add ``service_category``; a row-by-row step that streams accept too."""
    return claims.withColumn("service_category", service_category(F.col("procedure_code")))


ATTRIBUTES = ("specialty", "geography_state", "geography_region")
PROVIDER_RATES = ("oon_rate", "denial_rate", "appeal_rate", "dme_rate")


def provider_features(claims: DataFrame) -> DataFrame:
    """One row per provider with volumes, amounts, rates and the span of service dates.

    Of several attribute sets of one provider, the one that occurs on the earliest date is kept.
    """
    return provider_features_from(provider_parts(claims), member_pairs(claims))


def provider_parts(claims: DataFrame) -> DataFrame:
    """Partial sums per provider, code and descriptive attributes, which merge.

    All accumulators have a fixed width, so that the heavy step stays a hash aggregation and a hot
    provider is spread over its codes.
    """
    met = dict(zip(PROVIDER_RATES, (F.col(c) == v for c, v in (("network_status", "OON"), ("denial_flag", "Y"), ("appeal_flag", "Y"), ("dme_flag", "Y")))))
    return claims.groupBy("provider_id", "procedure_code", *ATTRIBUTES).agg(
        F.count("*").alias("n"),
        F.count("allowed_amount").alias("n_allowed"),
        F.count("units").alias("n_units"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
        *money.sum_parts("allowed_amount", "allowed"),
        *money.sum_parts("billed_amount", "billed"),
        *[count_where(is_met).alias(f"{name}_met") for name, is_met in met.items()],
        *[F.count(is_met).alias(f"{name}_known") for name, is_met in met.items()],
        F.min("service_date").alias("first_date"),
        F.max("service_date").alias("last_date"),
    )


def _added_provider_parts() -> list[Column]:
    sums = ("n", "n_allowed", "n_units", "units", *[f"{name}_{part}" for name in PROVIDER_RATES for part in ("met", "known")])
    return [*[F.sum(name).alias(name) for name in sums], *money.merge_parts("allowed"), *money.merge_parts("billed")]


def merge_provider_parts(parts: DataFrame) -> DataFrame:
    """Partial sums of several tables, one row per key again."""
    dates = (F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    return parts.groupBy("provider_id", "procedure_code", *ATTRIBUTES).agg(*_added_provider_parts(), *dates)


def member_pairs(claims: DataFrame) -> DataFrame:
    """The members of every provider. This second scan reads two columns and is far cheaper than expanding every row
    for a distinct count."""
    return merge_member_pairs(claims.select("provider_id", "member_id"))


def merge_member_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.distinct()


def provider_features_from(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Provider features from partial sums and distinct members."""
    merged = parts.groupBy("provider_id").agg(
        *_added_provider_parts(),
        F.min("first_date").alias("first_claim_date"),
        F.max("last_date").alias("last_claim_date"),
        F.countDistinct(F.struct("procedure_code")).alias("unique_procedure_codes"),
        F.min(F.struct("first_date", *ATTRIBUTES)).alias("first_seen"),
    )
    members = (
        pairs.groupBy("provider_id")
        .agg(F.count("*").alias("unique_members"))
        .withColumnRenamed("provider_id", "member_provider_id")
    )
    base = merged.join(
        members, F.col("provider_id").eqNullSafe(F.col("member_provider_id")), "left"
    ).select(
        "provider_id",
        F.col("n").alias("total_claims"),
        money.total("allowed").alias("total_allowed"),
        ratio(money.total("allowed"), F.col("n_allowed")).alias("avg_allowed"),
        money.total("billed").alias("total_billed"),
        ratio(F.col("units"), F.col("n_units")).alias("avg_units"),
        F.col("units").alias("total_units"),
        *[ratio(F.col(f"{name}_met"), F.col(f"{name}_known")).alias(name) for name in PROVIDER_RATES],
        "first_claim_date",
        "last_claim_date",
        "unique_members",
        "unique_procedure_codes",
        *[F.col(f"first_seen.{name}").alias(name) for name in ATTRIBUTES],
    )
    return derive_ratios(derive_dates_ages(base))


def derive_dates_ages(features: DataFrame) -> DataFrame:
    """Add ``entity_age_days``, the days between the first and the last claim."""
    return features.withColumn("entity_age_days", F.date_diff("last_claim_date", "first_claim_date").cast("long"))


def derive_ratios(features: DataFrame) -> DataFrame:
    """Add the ratio of billed to allowed totals and the cost per unit; null over zero."""
    return features.withColumns(
        {
            "avg_billed_to_allowed_ratio": ratio(F.col("total_billed"), F.col("total_allowed")),
            "cost_per_unit": ratio(F.col("total_allowed"), F.col("total_units")),
        }
    )


def service_category_features(claims: DataFrame) -> DataFrame:
    """One row per service category; tags the claims when they are not tagged yet."""
    return category_features_from(category_parts(claims))


def category_parts(claims: DataFrame) -> DataFrame:
    """Partial sums per service category, which merge."""
    if "service_category" not in claims.columns:
        claims = tag_service_category(claims)
    denied, oon = F.col("denial_flag") == "Y", F.col("network_status") == "OON"
    return claims.groupBy("service_category").agg(
        F.count("*").alias("n"),
        F.count("allowed_amount").alias("n_allowed"),
        *money.sum_parts("allowed_amount", "allowed"),
        *money.sum_parts("billed_amount", "billed"),
        count_where(denied).alias("denials"),
        F.count(denied).alias("n_denials"),
        count_where(oon).alias("oon"),
        F.count(oon).alias("n_oon"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
    )


def merge_category_parts(parts: DataFrame) -> DataFrame:
    sums = ("n", "n_allowed", "denials", "n_denials", "oon", "n_oon", "units")
    return parts.groupBy("service_category").agg(
        *[F.sum(name).alias(name) for name in sums], *money.merge_parts("allowed"), *money.merge_parts("billed")
    )


def category_features_from(parts: DataFrame) -> DataFrame:
    return parts.select(
        "service_category",
        F.col("n").alias("total_claims"),
        money.total("allowed").alias("total_allowed"),
        ratio(money.total("allowed"), F.col("n_allowed")).alias("avg_allowed"),
        money.total("billed").alias("total_billed"),
        ratio(F.col("denials"), F.col("n_denials")).alias("denial_rate"),
        ratio(F.col("oon"), F.col("n_oon")).alias("oon_rate"),
        F.col("units").alias("total_units"),
        ratio(money.total("allowed"), F.col("units")).alias("cost_per_unit"),
    )


def daily_parts(claims: DataFrame) -> DataFrame:
    """Partial sums per service date, which merge: the only step that sees every claim."""
    return claims.groupBy("service_date").agg(
        F.count("*").alias("n"),
        *money.sum_parts("allowed_amount", "allowed"),
        *money.sum_parts("billed_amount", "billed"),
        count_where(F.col("denial_flag") == "Y").alias("denials"),
        count_where(F.col("network_status") == "OON").alias("oon"),
    )


def _added_daily_parts() -> list[Column]:
    return [*[F.sum(name).alias(name) for name in ("n", "denials", "oon")], *money.merge_parts("allowed"), *money.merge_parts("billed")]


def merge_daily_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("service_date").agg(*_added_daily_parts())


def period_totals(claims: DataFrame, *period_types: str) -> DataFrame:
    """Totals per Monday-based week and/or calendar month, from one pass over the claims."""
    return period_totals_from(daily_parts(claims), *period_types)


def period_totals_from(days: DataFrame, *period_types: str) -> DataFrame:
    """Totals per week and/or month of partial sums per day."""
    starts = {"weekly": F.trunc("service_date", "week"), "monthly": F.trunc("service_date", "month")}
    periods = F.array(
        *[
            F.struct(F.lit(kind).alias("period_type"), starts[kind].alias("period_start"))
            for kind in period_types
        ]
    )
    return (
        days.withColumn("period", F.explode(periods))
        .groupBy("period.period_type", "period.period_start")
        .agg(*_added_daily_parts())
        .select(
            "period_start",
            F.col("n").alias("total_claims"),
            money.total("allowed").alias("total_allowed"),
            money.total("billed").alias("total_billed"),
            F.col("denials").alias("denial_count"),
            F.col("oon").alias("oon_count"),
            "period_type",
        )
    )


def rolling_claims(periods: DataFrame) -> DataFrame:
    """Add the mean claim count of the last 4 weeks or 3 months that have claims.

    The windows run over period totals, never over claims.
    """
    window = Window.partitionBy("period_type").orderBy("period_start")
    means = [
        F.when(
            F.col("period_type") == kind,
            F.avg("total_claims").over(window.rowsBetween(1 - length, Window.currentRow)),
        )
        for kind, length in ROLLING_PERIODS.items()
    ]
    return periods.withColumn("rolling_4w_claims", F.coalesce(*means))


def temporal_features(claims: DataFrame) -> DataFrame:
    """Weekly and monthly totals with rolling means in one table."""
    return rolling_claims(period_totals(claims, "weekly", "monthly"))


def all_features(claims: DataFrame) -> dict[str, DataFrame]:
    """The tagged claims and the three feature tables."""
    tagged = tag_service_category(claims)
    return {
        "claims": tagged,
        "provider": provider_features(tagged),
        "temporal": temporal_features(tagged),
        "service_category": service_category_features(tagged),
    }
