"""Utilization metrics against peer baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimgauge.config import DEFAULT_BASELINES, BenchmarkBaseline
from claimgauge.functions import money
from claimgauge.functions.ratios import count_where, rate


def internal_metrics(claims: DataFrame) -> DataFrame:
    """``metric_name, value`` of the metrics that baselines can refer to; zeros if empty."""
    counted = claims.agg(
        F.count("*").alias("n"),
        count_where(F.col("denial_flag") == "Y").alias("denials"),
        count_where(F.col("network_status") == "OON").alias("oon"),
        *money.sum_parts("allowed_amount", "allowed"),
    )
    n = F.col("n")
    wide = counted.select(
        F.round(rate(F.col("denials"), n), 4).alias("denial_rate"),
        F.round(rate(F.col("oon"), n), 4).alias("oon_rate"),
        F.round(rate(money.total("allowed"), n), 2).alias("cost_per_claim"),
    )
    return wide.unpivot([], wide.columns, "metric_name", "value")


def benchmark_compare(claims: DataFrame, baselines: tuple[BenchmarkBaseline, ...] = DEFAULT_BASELINES) -> DataFrame:
    """One row per baseline, in the given order; a metric that does not exist counts as 0."""
    table = claims.sparkSession.createDataFrame(
        [(i, b.metric_name, float(b.baseline_value), float(b.threshold_pct)) for i, b in enumerate(baselines)],
        "position INT, metric_name STRING, baseline_value DOUBLE, threshold_pct DOUBLE",
    )
    compared = table.join(internal_metrics(claims), "metric_name", "left").withColumn(
        "internal_value", F.coalesce("value", F.lit(0.0))
    )
    baseline, limit, variance = F.col("baseline_value"), F.col("threshold_pct"), F.col("variance")
    compared = compared.withColumn(
        "variance",
        F.when(baseline == 0, F.lit(0.0)).otherwise((F.col("internal_value") - baseline) / baseline),
    )
    return compared.orderBy("position").select(
        "metric_name",
        F.round("internal_value", 4).alias("internal_value"),
        "baseline_value",
        F.round(variance, 4).alias("variance"),
        "threshold_pct",
        (F.abs(variance) > limit).alias("exceeds_threshold"),
        F.when(variance > limit, "above").when(variance < -limit, "below").otherwise("within").alias("direction"),
    )


def flagged_count(comparison: DataFrame) -> DataFrame:
    """One row: how many metrics exceed their threshold."""
    return comparison.agg(count_where(F.col("exceeds_threshold")).alias("flagged_count"))
