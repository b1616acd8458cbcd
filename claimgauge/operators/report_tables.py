"""The tables behind the report and its charts, without any drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimgauge.config import DEFAULT_BASELINES, BenchmarkBaseline, DetectionConfig, PolicyChangeEvent
from claimgauge.functions import money
from claimgauge.functions.ratios import count_where, rate
from claimgauge.operators.appeals import denial_categories
from claimgauge.operators.benchmarks import benchmark_compare
from claimgauge.operators.detection import SEVERITIES, sort_flags
from claimgauge.operators.features import period_totals, rolling_claims
from claimgauge.operators.policy_events import policy_impact

# Fixed values.
HISTOGRAM_BINS = 100
CONTROL_WIDTH = 2
TOP_FLAGS = 20


def report_key_metrics(claims: DataFrame, flags: DataFrame) -> DataFrame:
    """``metric, value`` rows: volumes, totals, rates and the number of flags."""
    counted = claims.agg(
        F.count("*").alias("n"),
        *money.sum_parts("billed_amount", "billed"),
        *money.sum_parts("allowed_amount", "allowed"),
        count_where(F.col("denial_flag") == "Y").alias("denials"),
        count_where(F.col("appeal_flag") == "Y").alias("appeals"),
        count_where(F.col("network_status") == "OON").alias("oon"),
    )
    n = F.col("n")
    wide = counted.select(
        n.cast("double").alias("total_claims"),
        money.total("billed").alias("total_billed"),
        money.total("allowed").alias("total_allowed"),
        F.round(rate(F.col("denials"), n), 4).alias("overall_denial_rate"),
        F.round(rate(F.col("appeals"), F.col("denials")), 4).alias("overall_appeal_rate"),
        F.round(rate(F.col("oon"), n), 4).alias("oon_rate"),
        flags.agg(F.count("*").cast("double").alias("n_flags")).scalar().alias("total_flags"),
    )
    return wide.unpivot([], wide.columns, "metric", "value")


def report_cost_histogram(claims: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Claims per equal-width bin of the allowed amount; empty bins are listed with 0.

    Bins are closed on the left, the last one on both sides. If all amounts are equal, the range
    is widened by one half on either side.
    """
    amount = F.col("allowed_amount")
    known = claims.where(amount.isNotNull())
    bounds = known.agg(F.min(amount).alias("low"), F.max(amount).alias("high")).select(
        F.struct(
            F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
            F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        ).alias("bounds")
    )
    span = bounds.scalar()
    place = F.floor((amount - F.col("span.low")) * bins / (F.col("span.high") - F.col("span.low"))) + 1
    counted = (
        known.withColumn("span", span)
        .groupBy(F.least(place, F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    every = claims.sparkSession.range(1, bins + 1, numPartitions=1).select(F.col("id").cast("int").alias("bin"))
    width = (F.col("span.high") - F.col("span.low")) / bins
    return (
        every.join(counted, "bin", "left")
        .withColumn("span", span)
        .where(F.col("span.low").isNotNull())
        .select(
            "bin",
            F.round(F.col("span.low") + width * (F.col("bin") - 1), 4).alias("bin_start"),
            F.round(F.col("span.low") + width * F.col("bin"), 4).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("claims"),
        )
        .orderBy("bin")
    )


def report_utilization_trend(claims: DataFrame) -> DataFrame:
    """Weekly volume with its rolling mean and the control band of that mean."""
    weekly = rolling_claims(period_totals(claims, "weekly")).withColumn(
        "rolling_4w_claims", F.coalesce("rolling_4w_claims", F.lit(0.0))
    )
    center, deviation = F.avg("rolling_4w_claims"), F.stddev_pop("rolling_4w_claims")
    band = weekly.agg(
        F.struct(
            center.alias("mean"),
            (center + deviation * CONTROL_WIDTH).alias("upper"),
            F.greatest(F.lit(0.0), center - deviation * CONTROL_WIDTH).alias("lower"),
        ).alias("band")
    )
    return (
        weekly.withColumn("band", band.scalar())
        .orderBy("period_start")
        .select(
            "period_start",
            "total_claims",
            "rolling_4w_claims",
            *[F.round(f"band.{name}", 4).alias(f"band_{name}") for name in ("mean", "upper", "lower")],
        )
    )


def report_denial_funnel(claims: DataFrame) -> DataFrame:
    """Denials and appeals per reason, most denials first."""
    return funnel_rows(denial_categories(claims))


def funnel_rows(categories: DataFrame) -> DataFrame:
    return categories.select("category", "denial_count", "appeal_count")


def report_top_flags(flags: DataFrame) -> DataFrame:
    return (
        sort_flags(flags)
        .limit(TOP_FLAGS)
        .select(
            "rule_name",
            "entity_id",
            "severity",
            F.round("actual_value", 2).alias("actual_value"),
            F.round("threshold", 2).alias("threshold"),
            "description",
        )
    )


def flag_counts(flags: DataFrame) -> DataFrame:
    """One row: all flags and the flags of each severity."""
    return flags.agg(
        F.count("*").alias("total"),
        *[count_where(F.col("severity") == severity).alias(severity) for severity in SEVERITIES],
    )


def report_policy_impact(
    claims: DataFrame, events: list[PolicyChangeEvent], config: DetectionConfig = DetectionConfig()
) -> DataFrame:
    """``policy_id, metric, pre, post, change`` rows."""
    return impact_rows(policy_impact(claims, events, config))


def impact_rows(impact: DataFrame) -> DataFrame:
    def row(metric: str, name: str, change: str) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            F.col(f"pre_{name}").cast("double").alias("pre"),
            F.col(f"post_{name}").cast("double").alias("post"),
            F.col(change).alias("change"),
        )

    rows = F.array(
        row("Volume", "volume", "volume_change_pct"),
        row("Total Allowed", "total_allowed", "cost_change_pct"),
        row("Denial Rate", "denial_rate", "denial_rate_change"),
        row("OON Rate", "oon_rate", "oon_rate_change"),
    )
    return impact.select("policy_id", F.explode(rows).alias("row")).select("policy_id", "row.*")


def report_benchmarks(claims: DataFrame, baselines: tuple[BenchmarkBaseline, ...] = DEFAULT_BASELINES) -> DataFrame:
    """The comparison with a status column."""
    return benchmark_rows(benchmark_compare(claims, baselines))


def benchmark_rows(comparison: DataFrame) -> DataFrame:
    return comparison.select(
        "metric_name",
        "internal_value",
        "baseline_value",
        "variance",
        "threshold_pct",
        F.when(F.col("exceeds_threshold"), "FLAGGED").otherwise("OK").alias("status"),
    )
