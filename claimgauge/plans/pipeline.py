"""The claims run: check, features, flags, policy impact, appeals, benchmarks, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimgauge.config import PipelineConfig
from claimgauge.operators import appeals, benchmarks, detection, features, policy_events, report_tables, validation
from claimgauge.operators.stages import materialize, owned_stages
from claimgauge.sources.claims import load_claims, load_table, write_features
from claimgauge.sources.reports import write_reports


class ValidationFailed(ValueError):
    """The claims have critical issues; the validation report tells which."""


def check_claims(claims: DataFrame, output: str) -> None:
    """Write the validation report, from one scan of the claims; raise if there are critical issues."""
    scanned = materialize(validation.scan(claims), "scan")
    issues = validation.validate_issues(claims, scanned)
    written = write_reports(
        {"validation_report": validation.validate_claims(claims, scanned), "validation_issues": issues}, output
    )
    summary = claims.sparkSession.read.json(written["validation_report"]).first()
    if not summary["passed"]:
        raise ValidationFailed(f"{summary['critical_issues']} critical issues, see {written['validation_issues']}")


def analyze(claims: DataFrame, providers: DataFrame, config: PipelineConfig) -> dict[str, DataFrame]:
    """The detection and analysis tables, by report name; those that several reports read are stored."""
    stored = {
        "flags": detection.all_flags(providers, config.detection),
        "policy_impact": policy_events.policy_impact(claims, list(config.policy_events), config.detection),
        "denial_categories": appeals.denial_categories(claims),
        "benchmark_report": benchmarks.benchmark_compare(claims, config.benchmarks),
    }
    stored = {name: materialize(table, name) for name, table in stored.items()}
    return {
        **stored,
        "appeals_report": appeals.appeals_funnel(claims, config.cost_per_appeal),
        "top_appeal_providers": appeals.top_appeal_providers(claims),
        "benchmark_flagged": benchmarks.flagged_count(stored["benchmark_report"]),
    }


def report(claims: DataFrame, results: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The report tables, by name, from the claims and the tables of :func:`analyze`."""
    flags = results["flags"]
    return {
        "report_key_metrics": report_tables.report_key_metrics(claims, flags),
        "report_cost_histogram": report_tables.report_cost_histogram(claims),
        "report_utilization_trend": report_tables.report_utilization_trend(claims),
        "report_denial_funnel": report_tables.funnel_rows(results["denial_categories"]),
        "report_flag_counts": report_tables.flag_counts(flags),
        "report_top_flags": report_tables.report_top_flags(flags),
        "report_policy_impact": report_tables.impact_rows(results["policy_impact"]),
        "report_benchmarks": report_tables.benchmark_rows(results["benchmark_report"]),
    }


def run_all(spark: SparkSession, claims_path: str, output: str, config: PipelineConfig = PipelineConfig()) -> dict[str, str]:
    """Run every stage from stored claims to stored report tables.

    Stages hand over written tables: the columns a later stage needs are read again from parquet,
    which costs less than keeping all claims in executor memory. Intermediate tables are removed at the end.
    """
    with owned_stages(spark):
        claims = load_claims(spark, claims_path)
        check_claims(claims, output)
        tables = write_features(features.all_features(claims), output)
        enriched = load_table(spark, tables["claims"])
        results = analyze(enriched, load_table(spark, tables["provider"]), config)
        by_count = results["denial_categories"].orderBy(F.desc("denial_count"), "category")
        sorted_tables = {"flags": detection.sort_flags(results["flags"]), "denial_categories": by_count}
        written = write_reports({**results, **sorted_tables}, output)
        return {**tables, **written, **write_reports(report(enriched, results), output)}
