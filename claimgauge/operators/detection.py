"""Outlier rules over provider features; each returns a table of explained flags.

Peer statistics are one-row scalar subqueries, so no rule joins providers with each other or
brings values to the driver. Pass a stored or materialized feature table: every rule reads it
more than once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from claimgauge.config import DetectionConfig
from claimgauge.functions.ratios import is_finite
from claimgauge.functions.text import fixed, grouped, percent
from claimgauge.operators.order_stats import exact_median, nearest_quantiles

# Severities from the most to the least urgent, and the rules in reporting order.
SEVERITIES = ("high", "medium", "low")
RULES = (
    "high_volume_provider",
    "high_cost_provider",
    "new_entity_high_volume",
    "oon_dme_cluster",
    "billing_ratio_outlier",
)
# Fixed values of the rules themselves.
HIGH_ZSCORE = 3
DME_SHARE = 0.5
CONCENTRATED_CODES = 3

FLAG_COLUMNS = (
    "rule_name",
    "entity_type",
    "entity_id",
    "severity",
    "feature_values",
    "threshold",
    "actual_value",
    "description",
)


def provider_peer_stats(features: DataFrame, column: str, zscore_threshold: float) -> DataFrame:
    """One row: mean, sample deviation and the outlier threshold of a feature."""
    mean, std = F.avg(column), F.stddev_samp(column)
    return features.agg(
        mean.alias("peer_mean"), std.alias("peer_std"), (mean + std * zscore_threshold).alias("threshold")
    )


def _one(df: DataFrame) -> Column:
    """A one-row table as a struct value."""
    return df.select(F.struct("*")).scalar()


def _cents(name: str) -> Column:
    """An amount as JSON should show it: two places and no exponent."""
    return F.round(name, 2).cast("decimal(20,2)")


def _flags(
    rows: DataFrame,
    rule: str,
    severity: Column,
    values: dict[str, Column],
    threshold: Column,
    actual: Column,
    text: list,
    entity_type: str = "provider",
) -> DataFrame:
    pieces = [piece if isinstance(piece, Column) else F.lit(piece) for piece in text]
    return rows.select(
        F.lit(rule).alias("rule_name"),
        F.lit(entity_type).alias("entity_type"),
        F.col("provider_id").alias("entity_id"),
        severity.alias("severity"),
        F.to_json(F.struct(*[value.alias(name) for name, value in values.items()])).alias("feature_values"),
        threshold.cast("double").alias("threshold"),
        actual.cast("double").alias("actual_value"),
        F.concat(*pieces).alias("description"),
    )


def _above_peers(features: DataFrame, column: str, config: DetectionConfig) -> DataFrame:
    """Providers above mean + z * deviation, with ``peer`` and ``zscore``; none if all are equal."""
    peer = _one(provider_peer_stats(features, column, config.zscore_threshold))
    return (
        features.withColumn("peer", peer)
        .where((F.col("peer.peer_std") > 0) & (F.col(column) > F.col("peer.threshold")))
        .withColumn("zscore", (F.col(column) - F.col("peer.peer_mean")) / F.col("peer.peer_std"))
    )


def _zscore_severity() -> Column:
    return F.when(F.col("zscore") > HIGH_ZSCORE, "high").otherwise("medium")


def flags_high_volume_provider(features: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Claim volume far above that of all providers."""
    return _flags(
        _above_peers(features, "total_claims", config),
        "high_volume_provider",
        _zscore_severity(),
        {
            "total_claims": F.col("total_claims"),
            "peer_mean": F.round("peer.peer_mean", 1),
            "peer_std": F.round("peer.peer_std", 1),
            "z_score": F.round("zscore", 2),
        },
        F.round("peer.threshold", 1),
        F.col("total_claims"),
        [
            "Provider ", F.col("provider_id"), " has ", F.col("total_claims").cast("string"),
            " claims (z-score=", fixed(F.round("zscore", 2), 2),
            ", threshold=", fixed(F.round("peer.threshold", 0), 0), ")",
        ],
    )


def flags_high_cost_provider(features: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Total allowed amount far above that of all providers."""
    cost = F.round("total_allowed", 2)
    return _flags(
        _above_peers(features, "total_allowed", config),
        "high_cost_provider",
        _zscore_severity(),
        {
            "total_allowed": _cents("total_allowed"),
            "peer_mean": _cents("peer.peer_mean"),
            "peer_std": _cents("peer.peer_std"),
            "z_score": F.round("zscore", 2),
        },
        F.round("peer.threshold", 2),
        cost,
        [
            "Provider ", F.col("provider_id"), " has $", grouped(cost, 2),
            " total allowed (z-score=", fixed(F.round("zscore", 2), 2),
            ", threshold=$", grouped(F.round("peer.threshold", 0)), ")",
        ],
    )


def flags_new_entity_high_volume(features: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Providers seen for a short time that bill more than most established ones.

    A provider of unknown age is neither new nor established.
    """
    age = F.col("entity_age_days")
    established = features.where(age >= config.new_entity_days)
    volume = nearest_quantiles(
        established, [], "total_claims", {"threshold": config.new_entity_volume_percentile}
    )
    flagged = (
        features.where(age < config.new_entity_days)
        .withColumn("peer", _one(volume))
        .where(F.col("total_claims") > F.col("peer.threshold"))
    )
    return _flags(
        flagged,
        "new_entity_high_volume",
        F.lit("high"),
        {name: F.col(name) for name in ("total_claims", "entity_age_days", "specialty")},
        F.col("peer.threshold"),
        F.col("total_claims"),
        [
            "New provider ", F.col("provider_id"), " (age=", age.cast("string"),
            "d) has ", F.col("total_claims").cast("string"),
            " claims, exceeding the 90th percentile of established providers (",
            fixed(F.col("peer.threshold"), 0), ")",
        ],
    )


def flags_oon_dme_cluster(features: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Equipment suppliers mostly out of network, busy, and billing very few codes."""
    suppliers = features.where(F.col("dme_rate") > DME_SHARE)
    volume = exact_median(suppliers, [], "total_claims", "median")
    flagged = (
        suppliers.where(
            (F.col("oon_rate") > config.oon_rate_threshold)
            & (F.col("unique_procedure_codes") <= CONCENTRATED_CODES)
        )
        .withColumn("peer", _one(volume))
        .where(F.col("total_claims") >= F.col("peer.median"))
    )
    return _flags(
        flagged,
        "oon_dme_cluster",
        F.lit("high"),
        {
            "oon_rate": F.round("oon_rate", 3),
            "dme_rate": F.round("dme_rate", 3),
            "unique_procedure_codes": F.col("unique_procedure_codes"),
            "total_claims": F.col("total_claims"),
            "total_allowed": _cents("total_allowed"),
            "entity_age_days": F.col("entity_age_days"),
            "geography_state": F.col("geography_state"),
        },
        F.lit(config.oon_rate_threshold),
        F.round("oon_rate", 3),
        [
            "DME supplier ", F.col("provider_id"), " has ", percent(F.col("oon_rate"), 0),
            " OON rate, ", F.col("total_claims").cast("string"),
            " claims, only ", F.col("unique_procedure_codes").cast("string"),
            " unique codes. Possible OON DME billing scheme.",
        ],
        entity_type="supplier",
    )


def is_finite_filter(features: DataFrame, column: str) -> DataFrame:
    """Keep the rows whose value is neither null, NaN nor infinite."""
    return features.where(is_finite(F.col(column)))


def flags_billing_ratio_outlier(features: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Billed-to-allowed ratio several times the median of all providers."""
    column = "avg_billed_to_allowed_ratio"
    valid = is_finite_filter(features, column)
    median = exact_median(valid, [], column, "median")
    limit = F.col("peer.median") * config.billing_ratio_multiplier
    flagged = valid.withColumn("peer", _one(median)).where(
        (F.col("peer.median") != 0) & (F.col(column) > limit)
    )
    return _flags(
        flagged,
        "billing_ratio_outlier",
        F.lit("medium"),
        {
            "billed_to_allowed_ratio": F.round(column, 3),
            "peer_median_ratio": F.round("peer.median", 3),
            "total_claims": F.col("total_claims"),
        },
        F.round(limit, 3),
        F.round(column, 3),
        [
            "Provider ", F.col("provider_id"), " has a billed/allowed ratio of ",
            fixed(F.round(column, 2), 2), " vs peer median of ", fixed(F.round("peer.median", 2), 2),
            " (threshold=", fixed(F.round(limit, 2), 2), ")",
        ],
    )


DETECTORS = (
    flags_high_volume_provider,
    flags_high_cost_provider,
    flags_new_entity_high_volume,
    flags_oon_dme_cluster,
    flags_billing_ratio_outlier,
)


def all_flags(features: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """The flags of all rules in one table, unsorted."""
    return reduce(DataFrame.unionByName, [detect(features, config) for detect in DETECTORS])


def _position(column: str, order: tuple[str, ...]) -> Column:
    """Place of the value in ``order``; values that are not in it come last."""
    place = F.array_position(F.lit(list(order)), F.col(column))
    return F.when(place > 0, place).otherwise(len(order) + 1)


def flag_order() -> list[Column]:
    """Most severe first, then rule by rule, then by entity."""
    return [_position("severity", SEVERITIES), _position("rule_name", RULES), F.col("entity_id")]


def sort_flags(flags: DataFrame) -> DataFrame:
    return flags.orderBy(*flag_order())


def top_flags(flags: DataFrame, n: int = 20) -> DataFrame:
    return sort_flags(flags).limit(n)
