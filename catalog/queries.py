"""One query per operator, over claims derived from the order tables.

Lists and structs are returned as text, so that results compare by value across engines.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimgauge.config import PolicyChangeEvent
from claimgauge.functions import money
from claimgauge.functions.codes import diagnosis_list
from claimgauge.operators import (
    appeals,
    benchmarks,
    detection,
    feature_state,
    features,
    kpis,
    matching,
    order_stats,
    policy_docs,
    policy_events,
    reconcile,
    report_tables,
    seeds,
    top_codes,
    validation,
)
from claimgauge.operators.joins import join_groups
from claimgauge.operators.stages import compiled_methods, materialize, scratch_path
from claimgauge.plans.policy_insights import kpis_from_claims, rules_from_claims
from claimgauge.schema import CLAIMS
from claimgauge.sources import claims as claim_tables, external_csv, monthly_claims, policies, policy_files, reports
from claimgauge.streaming import routing
from catalog.order_claims import LINE, derive, order_claims, order_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Service dates of the driver tables run from 1995 to 2001.
EVENTS = [
    PolicyChangeEvent("POL-001", ("CPT-7",), "removed", dt.date(1999, 7, 1), "Imaging without authorization"),
    PolicyChangeEvent("POL-002", ("HCPCS-E", "CPT-99"), "removed", dt.date(2001, 8, 15), "Equipment and visits"),
    PolicyChangeEvent("POL-003", ("CPT-80",), "added", dt.date(1998, 1, 1), "Laboratory needs authorization"),
    PolicyChangeEvent("POL-004", ("NONEXISTENT",), "removed", dt.date(1999, 7, 1), "Nothing affected"),
]
WEEKS = 12
#: Code prefixes that events derived from the part table take in turn.
EVENT_PREFIXES = ("CPT-7", "CPT-70102", "HCPCS-E", "CPT-99", "CPT", "RX-0100", "CPT-80101", "NONE")
RULE_LISTS = ("covered_cpt_codes", "diagnosis_constraints", "documentation_requirements")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def as_text(name: str) -> Column:
    return F.array_join(name, "|")


def with_faults(claims: DataFrame) -> DataFrame:
    """Claims with damage of every kind that the critical checks look for."""
    denied = F.col("denial_flag") == "Y"
    return claims.withColumns(
        {
            "member_id": F.when(~((F.col("grievance_flag") == "Y") & denied), F.col("member_id")),
            "billed_amount": F.when(F.col("denial_reason_category") == "duplicate", -F.col("billed_amount")).otherwise(
                F.col("billed_amount")
            ),
            "units": F.when(F.col("units") == 1, F.lit(0)).otherwise(F.col("units")),
            "network_status": F.when(F.col("plan_type") == "EPO", F.lower("network_status")).otherwise(
                F.col("network_status")
            ),
            "payer_product": F.when(
                (F.col("authorization_required") == "Y") & F.col("authorization_id").isNull(),
                F.concat(F.lit("Plan "), "provider_id"),
            ).otherwise(F.col("payer_product")),
            "denial_reason_category": F.when(denied & (F.col("place_of_service") == "23"), F.lit(None))
            .when(F.col("denial_reason_category") == "coding_error", "typing_error")
            .otherwise(F.col("denial_reason_category")),
            "claim_received_date": F.when(
                denied & (F.col("claim_type") == "Pharmacy"), F.date_sub("service_date", 1)
            ).otherwise(F.col("claim_received_date")),
        }
    )


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider features as a stored table, which is what the rules expect."""
    return stored_providers(stored_claims(spark, sf_dir, FEATURE_COLUMNS))


def stored_providers(claims: DataFrame) -> DataFrame:
    return materialize(features.provider_features(claims), "provider-features")


POLICY_COLUMNS = (
    "claim_id", "procedure_code", "claim_type", "specialty", "diagnosis_codes", "billed_amount", "allowed_amount",
    "denial_flag",
)
IMPACT_COLUMNS = ("procedure_code", "service_date", "allowed_amount", "denial_flag", "network_status")
FEATURE_COLUMNS = (
    "provider_id", "member_id", "procedure_code", "service_date", "billed_amount", "allowed_amount", "units",
    "network_status", "denial_flag", "appeal_flag", "dme_flag", "specialty", "geography_state", "geography_region",
)


def stored_claims(spark: SparkSession, sf_dir: str, columns=POLICY_COLUMNS) -> DataFrame:
    """The needed claims columns, derived and written once.

    For plans that pass over the claims several times or test derived columns many times: the
    scan of a stored table is cheaper than deriving claims anew, and its filters reach the reader.
    """
    return materialize(order_claims(spark, sf_dir).select(*columns), "claims")


def cluster_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.policy_seeds(stored_claims(spark, sf_dir))


def stored_rules(claims: DataFrame) -> DataFrame:
    """The rules that the claims suggest, as a stored table: matching reads them several times."""
    return materialize(rules_from_claims(claims), "policy-rules")


def external_rows(claims: DataFrame) -> DataFrame:
    """Claims in the ten external columns, with all the statuses, date styles and gaps of such files."""
    denied = F.col("denial_flag") == "Y"
    first_code = diagnosis_list(F.col("diagnosis_codes"))[0]
    return claims.select(
        F.col("claim_id").alias("ClaimID"),
        F.col("member_id").alias("PatientID"),
        F.col("provider_id").alias("ProviderID"),
        F.col("billed_amount").alias("ClaimAmount"),
        F.when(F.col("paid_date").isNull(), F.date_format("service_date", "MM/dd/yyyy"))
        .otherwise(F.date_format("service_date", "yyyy-MM-dd"))
        .alias("ClaimDate"),
        F.when(F.col("grievance_flag") == "Y", "")
        .when(F.col("plan_type") == "EPO", F.lit(None))
        .otherwise(first_code)
        .alias("DiagnosisCode"),
        F.col("procedure_code").alias("ProcedureCode"),
        F.col("specialty").alias("ProviderSpecialty"),
        F.when(F.col("geography_state") == "CA", F.upper("claim_type")).otherwise(F.col("claim_type")).alias("ClaimType"),
        F.when(denied & (F.col("appeal_flag") == "Y"), "Rejected")
        .when(denied, "DENIED")
        .when(F.col("facility_id").isNull(), "Pending")
        .otherwise("Approved")
        .alias("ClaimStatus"),
    )


# Sources and sinks


def claims_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims by month: all of them, then the later half of the months once more in a corrected batch.

    Their order lines are stored and dealt with month and code; the tasks that write the months derive the claims.
    """
    lines = derive(order_lines(spark, sf_dir), ["service_date", "procedure_code"], [*LINE])
    lines = materialize(lines, "lines", monthly_claims.COMPRESSION)
    path = scratch_path(spark, "claims-by-month")
    later = F.col("service_date") >= F.lit(dt.date(1996, 1, 1))

    def dealt_claims(batch: DataFrame) -> DataFrame:
        dealt = monthly_claims.deal_by_month(batch, "l_orderkey").select(*LINE, monthly_claims.MONTH)
        return derive(dealt, CLAIMS.names, [monthly_claims.MONTH])

    faulty = F.when(later, -F.col("units")).otherwise(F.col("units"))
    monthly_claims.write_months(dealt_claims(lines).withColumn("units", faulty), path)
    monthly_claims.write_months(dealt_claims(lines.where(later)), path)
    return monthly_claims.load_claims_by_month(spark, path)


@query
def load_claims_by_month(spark, sf_dir):
    return claims_by_month(spark, sf_dir).drop(monthly_claims.MONTH)


@query
def window_filter_by_month(spark, sf_dir):
    kept = policy_events.window_filter(claims_by_month(spark, sf_dir), EVENTS[0].effective_date, WEEKS)
    return kept.select("claim_id", "service_date", "period")


@query
def policy_impact_by_month(spark, sf_dir):
    impact = policy_events.policy_impact(claims_by_month(spark, sf_dir), events_from_parts(spark, sf_dir))
    return impact.withColumn("affected_services", as_text("affected_services"))


@query
def load_claims(spark, sf_dir):
    path = claim_tables.save_claims(order_claims(spark, sf_dir), scratch_path(spark, "claims"))
    return claim_tables.load_claims(spark, path)


@query
def load_external_csv(spark, sf_dir):
    path = scratch_path(spark, "external")
    external_rows(order_claims(spark, sf_dir)).write.option("header", True).csv(path)
    return external_csv.load_external_csv(spark, path)


@query
def write_features(spark, sf_dir):
    path = scratch_path(spark, "features")
    written = claim_tables.write_features({"claims": features.tag_service_category(order_claims(spark, sf_dir))}, path)
    tables = features.all_features(claim_tables.load_table(spark, written["claims"]))
    written |= claim_tables.write_features({name: tables[name] for name in tables if name != "claims"}, path)
    sizes = [
        claim_tables.load_table(spark, written[name]).agg(F.lit(name).alias("feature_set"), F.count("*").alias("n_rows"))
        for name in written
    ]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(sizes[3])


@query
def write_policy_seeds(spark, sf_dir):
    """The parquet table, with its codes as JSON text, and the JSON lines, each under its format's name."""
    parquet, lines = policies.write_policy_seeds(cluster_seeds(spark, sf_dir), scratch_path(spark, "seeds"))
    table = spark.read.parquet(parquet)
    listed = table.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(
        "top_diagnosis_codes:string", "top_diagnosis_codes:array<struct<code:string,count:bigint>>"
    )
    written = spark.read.schema(", ".join(re.sub(":", " ", field, count=1) for field in re.split(r",(?![^<]*>)", listed))).json(lines)
    rows = written.withColumn("top_diagnosis_codes", F.to_json("top_diagnosis_codes")).withColumn("kind", F.lit("jsonl"))
    return table.withColumn("kind", F.lit("parquet")).unionByName(rows)


@query
def write_policy_docs(spark, sf_dir):
    docs = policy_docs.render_policy_docs(cluster_seeds(spark, sf_dir))
    path = policies.write_policy_docs(docs, scratch_path(spark, "policy-docs"))
    return spark.read.parquet(path).select("file_name", "md")


@query
def parse_policy_files(spark, sf_dir):
    """Rules parsed from Markdown files, one per policy, as a folder of documents holds them."""
    docs = policy_docs.render_policy_docs(cluster_seeds(spark, sf_dir))
    folder = policies.export_policy_files(docs, scratch_path(spark, "policy-files"))
    rules = policies.load_policy_rules(spark, policies.parse_policies_dir(spark, folder, scratch_path(spark, "policy-rules")))
    return rules.withColumns({name: as_text(name) for name in RULE_LISTS})


@query
def write_policy_files(spark, sf_dir):
    folder = scratch_path(spark, "policy-files")
    policy_files.write_policy_files(cluster_seeds(spark, sf_dir), folder)
    return policy_files.read_written_files(spark, folder)


@query
def load_policy_rules(spark, sf_dir):
    rules = rules_from_claims(stored_claims(spark, sf_dir))
    path = policies.write_policy_rules(rules, scratch_path(spark, "policy-rules"))
    return policies.load_policy_rules(spark, path).withColumns({name: as_text(name) for name in RULE_LISTS})


@query
def write_reports(spark, sf_dir):
    table = {"appeals_report": appeals.appeals_funnel(order_claims(spark, sf_dir))}
    path = reports.write_reports(table, scratch_path(spark, "reports"))["appeals_report"]
    schema = (
        "total_claims BIGINT, total_denials BIGINT, total_appeals BIGINT, total_grievances BIGINT, "
        "overall_denial_rate DOUBLE, overall_appeal_rate DOUBLE, estimated_admin_cost DOUBLE"
    )
    return spark.read.schema(schema).json(path)


# Projections and filters


@query
def tag_service_category(spark, sf_dir):
    return features.tag_service_category(order_claims(spark, sf_dir)).select("claim_id", "procedure_code", "service_category")


@query
def adapt_external_claims(spark, sf_dir):
    external = external_rows(order_claims(spark, sf_dir)).withColumn("ClaimDate", F.try_to_date("ClaimDate", "yyyy-MM-dd"))
    return external_csv.adapt_external_claims(external).select(
        "claim_id", "service_date", "paid_date", "claim_type", "diagnosis_codes", "allowed_amount", "paid_amount",
        "denial_flag", "denial_reason_category",
    )


@query
def apply_policy_event(spark, sf_dir):
    applied = policy_events.apply_policy_event(order_claims(spark, sf_dir), EVENTS)
    return applied.select("claim_id", "procedure_code", "service_date", "authorization_required")


@query
def prefix_filter(spark, sf_dir):
    kept = policy_events.prefix_filter(order_claims(spark, sf_dir), ("CPT-7", "HCPCS-E"))
    return kept.select("claim_id", "procedure_code")


@query
def window_filter(spark, sf_dir):
    kept = policy_events.window_filter(order_claims(spark, sf_dir), EVENTS[0].effective_date, WEEKS)
    return kept.select("claim_id", "service_date", "period")


@query
def derive_dates_ages(spark, sf_dir):
    spans = order_claims(spark, sf_dir).groupBy("member_id").agg(
        F.min("service_date").alias("first_claim_date"), F.max("service_date").alias("last_claim_date")
    )
    return features.derive_dates_ages(spans)


@query
def derive_ratios(spark, sf_dir):
    claims = order_claims(spark, sf_dir).select(
        "claim_id",
        F.col("billed_amount").alias("total_billed"),
        F.col("paid_amount").alias("total_allowed"),
        F.col("units").alias("total_units"),
    )
    return features.derive_ratios(claims)


@query
def is_finite_filter(spark, sf_dir):
    claims = order_claims(spark, sf_dir).select("claim_id", F.try_divide("billed_amount", "paid_amount").alias("ratio"))
    return detection.is_finite_filter(claims, "ratio")


# Validation


@query
def validate_claims(spark, sf_dir):
    return validation.validate_claims(order_claims(spark, sf_dir))


@query
def validate_issues(spark, sf_dir):
    # Scanned for counts and again for examples.
    claims = materialize(with_faults(order_claims(spark, sf_dir)), "claims")
    issues = validation.validate_issues(claims)
    return issues.withColumn("examples", as_text("examples"))


@query
def column_presence(spark, sf_dir):
    """A stored table without two of the columns, checked as it is loaded."""
    path = claim_tables.save_claims(order_claims(spark, sf_dir).drop("facility_id", "supplier_type"), scratch_path(spark, "claims"))
    issues = validation.validate_issues(claim_tables.load_claims(spark, path))
    return issues.withColumn("examples", as_text("examples"))


@query
def zero_variance(spark, sf_dir):
    """A table whose paid amounts are all the same, with a column that nobody knows and that is mostly null."""
    claims = order_claims(spark, sf_dir).withColumns(
        {"paid_amount": F.lit(10.0), "note": F.when(F.col("claim_type") == "Pharmacy", F.lit("x"))}
    )
    issues = validation.validate_issues(claims)
    return issues.where("rule = 'zero_variance' OR message LIKE '%note%'").withColumn("examples", as_text("examples"))


@query
def route_valid_rows(spark, sf_dir):
    routed = validation.route_valid_rows(with_faults(order_claims(spark, sf_dir)))
    return routed.select("claim_id", as_text("failed_rules").alias("failed_rules"))


@query
def route_arriving_claims(spark, sf_dir):
    """Claims that arrive in two lots of files; the routing is started three times from its checkpoint.

    A lot has as many files as its claims have partitions; three quarters of them, three at least, make a batch.
    """
    claims = with_faults(order_claims(spark, sf_dir))
    folder = scratch_path(spark, "arriving")
    early = F.col("service_date") < F.lit(dt.date(1998, 1, 1))
    earlier = 0
    for lot in (claims.where(early), claims.where(~early)):
        with compiled_methods(spark):
            lot.write.mode("append").parquet(f"{folder}/claims")
        files = len(spark.read.schema(claims.schema).parquet(f"{folder}/claims").inputFiles())
        batch = max(3, (files - earlier) * 3 // 4)
        routing.route_arrived(spark, f"{folder}/claims", f"{folder}/routed", claims.schema, files_per_batch=batch)
        earlier = files
    routing.route_arrived(spark, f"{folder}/claims", f"{folder}/routed", claims.schema)
    routed = routing.load_routed(spark, f"{folder}/routed")
    return routed["valid"].select("claim_id", F.lit("").alias("failed_rules")).union(
        routed["rejected"].select("claim_id", as_text("failed_rules"))
    )


# Aggregations


@query
def provider_features(spark, sf_dir):
    return features.provider_features(order_claims(spark, sf_dir))


@query
def service_category_features(spark, sf_dir):
    return features.service_category_features(order_claims(spark, sf_dir))


@query
def temporal_weekly(spark, sf_dir):
    return features.period_totals(order_claims(spark, sf_dir), "weekly")


@query
def temporal_monthly(spark, sf_dir):
    return features.period_totals(order_claims(spark, sf_dir), "monthly")


@query
def rolling_claims(spark, sf_dir):
    periods = features.period_totals(order_claims(spark, sf_dir), "weekly", "monthly")
    return features.rolling_claims(periods).select("period_type", "period_start", "rolling_4w_claims")


@query
def temporal_features(spark, sf_dir):
    return features.temporal_features(order_claims(spark, sf_dir))


@query
def policy_seeds(spark, sf_dir):
    return cluster_seeds(spark, sf_dir).withColumn("top_diagnosis_codes", F.to_json("top_diagnosis_codes"))


@query
def sort_seeds(spark, sf_dir):
    ranked = seeds.sort_seeds(seeds.policy_seeds(stored_claims(spark, sf_dir), min_claims=1, top_n_dx=1))
    return ranked.select("procedure_code", "claim_type", "specialty", "n_claims", "p50_claim_amount")


@query
def nearest_quantile(spark, sf_dir):
    return order_stats.nearest_quantiles(
        stored_claims(spark, sf_dir, ("claim_type", "specialty", "allowed_amount")),
        ["claim_type", "specialty"],
        "allowed_amount",
        {"p10": 0.1, "p50": 0.5, "p90": 0.9},
    )


@query
def continuous_quantile(spark, sf_dir):
    """Quantiles of a ratio, whose values hardly repeat, and of the same values squeezed into one hair's breadth."""
    claims = stored_claims(spark, sf_dir, ("claim_type", "billed_amount", "allowed_amount")).where("allowed_amount > 0")
    ratio = F.col("billed_amount") / F.col("allowed_amount")
    values = claims.select(F.explode(F.array(F.struct(F.lit("ratio").alias("kind"), ratio.alias("v")),
                                             F.struct(F.lit("close").alias("kind"), (1000 + ratio / 1e6).alias("v")))).alias("x")).select("x.*")
    return order_stats.nearest_quantiles(values, ["kind"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99})


@query
def exact_median(spark, sf_dir):
    amounts = stored_claims(spark, sf_dir, ("provider_id", "billed_amount"))
    return order_stats.exact_median(amounts, ["provider_id"], "billed_amount", "median_billed")


@query
def top_k_codes(spark, sf_dir):
    top = top_codes.top_k_codes(order_claims(spark, sf_dir), ["specialty", "claim_type"], 4)
    return top.withColumn("top_diagnosis_codes", F.to_json("top_diagnosis_codes"))


@query
def policy_kpis(spark, sf_dir):
    claims = stored_claims(spark, sf_dir)
    rows = kpis_from_claims(claims, stored_rules(claims))
    return rows.withColumns({"top_dx": as_text("top_dx"), "top_specialties": as_text("top_specialties")})


@query
def appeals_funnel(spark, sf_dir):
    return appeals.appeals_funnel(order_claims(spark, sf_dir))


@query
def denial_categories(spark, sf_dir):
    return appeals.denial_categories(order_claims(spark, sf_dir))


@query
def top_denial_categories(spark, sf_dir):
    return appeals.top_denial_categories(order_claims(spark, sf_dir))


@query
def provider_appeals(spark, sf_dir):
    return appeals.provider_appeals(with_faults(order_claims(spark, sf_dir)))


@query
def top_appeal_providers(spark, sf_dir):
    return appeals.top_appeal_providers(order_claims(spark, sf_dir))


@query
def internal_metrics(spark, sf_dir):
    return benchmarks.internal_metrics(order_claims(spark, sf_dir))


@query
def benchmark_compare(spark, sf_dir):
    return benchmarks.benchmark_compare(order_claims(spark, sf_dir))


@query
def flagged_count(spark, sf_dir):
    return benchmarks.flagged_count(benchmarks.benchmark_compare(order_claims(spark, sf_dir)))


@query
def odd_amounts(spark, sf_dir):
    """Totals per claim type of amounts of which some are not a number or infinite."""
    amount = F.when((F.col("claim_type") == "Pharmacy") & (F.col("denial_flag") == "Y"), F.lit(float("nan"))).when(
        (F.col("claim_type") == "Institutional") & (F.col("denial_flag") == "Y"), F.lit(float("inf"))
    )
    claims = order_claims(spark, sf_dir).withColumn("allowed_amount", F.coalesce(amount, F.col("allowed_amount")))
    totals = claims.groupBy("claim_type").agg(*money.sum_parts("allowed_amount", "allowed"))
    total = money.total("allowed")
    return totals.select(
        "claim_type",
        F.isnan(total).alias("not_a_number"),
        (total == float("inf")).alias("infinite"),
        F.when(F.abs(total) < 1e15, F.round(total, 2)).alias("total_allowed"),
    )


@query
def period_metrics(spark, sf_dir):
    return policy_events.period_metrics(order_claims(spark, sf_dir))


@query
def policy_impact(spark, sf_dir):
    impact = policy_events.policy_impact(stored_claims(spark, sf_dir, IMPACT_COLUMNS), EVENTS)
    return impact.withColumn("affected_services", as_text("affected_services"))


def events_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy event per part: one or two code prefixes and a date, by its key."""
    key = F.col("p_partkey")
    first = F.element_at(F.array(*map(F.lit, EVENT_PREFIXES)), (key % len(EVENT_PREFIXES) + 1).cast("int"))
    second = F.element_at(F.array(*map(F.lit, EVENT_PREFIXES)), (F.floor(key / 7) % len(EVENT_PREFIXES) + 1).cast("int"))
    return claim_tables.load_table(spark, f"{sf_dir}/part.parquet").select(
        key.cast("long").alias("position"),
        F.concat(F.lit("EV-"), key.cast("string")).alias("policy_id"),
        F.lit("Derived event").alias("description"),
        F.date_add(F.lit(dt.date(1995, 1, 1)), (key * 37 % 2500).cast("int")).alias("effective_date"),
        F.when(key % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("affected_services"),
        F.when(key % 4 == 0, "added").otherwise("removed").alias("change_type"),
    )


@query
def policy_impact_from_table(spark, sf_dir):
    impact = policy_events.policy_impact(stored_claims(spark, sf_dir, IMPACT_COLUMNS), events_from_parts(spark, sf_dir))
    return impact.withColumn("affected_services", as_text("affected_services"))


@query
def apply_events_from_table(spark, sf_dir):
    events = events_from_parts(spark, sf_dir).where(F.col("effective_date") >= F.lit(dt.date(1999, 6, 1)))
    applied = policy_events.apply_policy_event(order_claims(spark, sf_dir), events)
    return applied.select("claim_id", "procedure_code", "service_date", "authorization_required")


@query
def provider_peer_stats(spark, sf_dir):
    table = features.provider_features(order_claims(spark, sf_dir))
    stats = detection.provider_peer_stats(table, "total_claims", 2.0)
    return stats.select(*[F.round(name, 4).alias(name) for name in stats.columns])


# Joins


@query
def match_score(spark, sf_dir):
    """Each claim against the rule of its own cluster."""
    claims = stored_claims(spark, sf_dir).withColumn("source_file", policy_docs.policy_file_name())
    pairs = join_groups(claims, rules_from_claims(claims), ["source_file"], "inner")
    return matching.match_score(pairs).select("claim_id", "policy_id", "match_confidence")


@query
def match_claims_to_policies(spark, sf_dir):
    claims = stored_claims(spark, sf_dir)
    matched = matching.match_claims_to_policies(claims, stored_rules(claims))
    return matched.select("claim_id", "procedure_code", "policy_id", "match_confidence")


@query
def match_claims_by_join(spark, sf_dir):
    """The same with rules that were written to and read from storage."""
    claims = stored_claims(spark, sf_dir)
    path = policies.write_policy_rules(rules_from_claims(claims), scratch_path(spark, "policy-rules"))
    matched = matching.match_claims_to_policies(claims, policies.load_policy_rules(spark, path))
    return matched.select("claim_id", "procedure_code", "policy_id", "match_confidence")


# Sorts, limits and set operations


@query
def rank_policies(spark, sf_dir):
    claims = stored_claims(spark, sf_dir)
    return kpis.rank_policies(kpis_from_claims(claims, stored_rules(claims)), "denial_rate")


@query
def append_claims(spark, sf_dir):
    claims = order_claims(spark, sf_dir)
    both = reconcile.append_claims(claims, policy_events.apply_policy_event(claims, EVENTS))
    return both.select("claim_id", "provider_id", "procedure_code", "service_date", "allowed_amount", "authorization_required")


def _features_after_appending(name: str) -> Query:
    """Features from a stored state that took the older claims first and the newer ones as a second batch."""

    def run(spark, sf_dir):
        # Each of the state's four tables reads its batch.
        claims = stored_claims(spark, sf_dir, FEATURE_COLUMNS)
        older = F.col("service_date") < F.lit(dt.date(1999, 1, 1))
        root = scratch_path(spark, "feature-state")
        for batch_name, batch in (("older", claims.where(older)), ("newer", claims.where(~older))):
            feature_state.append_to_state(spark, root, batch, batch_name)
        return feature_state.features_from_state(feature_state.load_state(spark, root))[name]

    run.__name__ = f"appended_{name}_features"
    return run


for appended in ("provider", "temporal", "service_category"):
    query(_features_after_appending(appended))


@query
def code_reconciliation(spark, sf_dir):
    claims = stored_claims(spark, sf_dir)
    tagged = features.tag_service_category(claims)
    return reconcile.code_reconciliation(
        {"claims": claims, "enriched": tagged, "seeds": seeds.policy_seeds(claims, min_claims=100)}
    )


@query
def concentration_share(spark, sf_dir):
    return reconcile.concentration_share(stored_claims(spark, sf_dir, ("billed_amount",)))


# Detection


@query
def flags_high_volume_provider(spark, sf_dir):
    return detection.flags_high_volume_provider(providers(spark, sf_dir))


@query
def flags_high_cost_provider(spark, sf_dir):
    return detection.flags_high_cost_provider(providers(spark, sf_dir))


@query
def flags_new_entity_high_volume(spark, sf_dir):
    return detection.flags_new_entity_high_volume(providers(spark, sf_dir))


@query
def flags_oon_dme_cluster(spark, sf_dir):
    return detection.flags_oon_dme_cluster(providers(spark, sf_dir))


@query
def flags_billing_ratio_outlier(spark, sf_dir):
    return detection.flags_billing_ratio_outlier(providers(spark, sf_dir))


@query
def all_flags(spark, sf_dir):
    return detection.all_flags(providers(spark, sf_dir))


@query
def sort_flags(spark, sf_dir):
    return detection.sort_flags(detection.all_flags(providers(spark, sf_dir))).select("severity", "rule_name", "entity_id")


@query
def top_flags(spark, sf_dir):
    return detection.top_flags(detection.all_flags(providers(spark, sf_dir)))


# Policy documents


@query
def render_policy_docs(spark, sf_dir):
    return policy_docs.render_policy_docs(cluster_seeds(spark, sf_dir))


@query
def parse_policy_docs(spark, sf_dir):
    rules = rules_from_claims(stored_claims(spark, sf_dir))
    return rules.withColumns({name: as_text(name) for name in RULE_LISTS})


@query
def roundtrip_check(spark, sf_dir):
    rows = cluster_seeds(spark, sf_dir)
    return policy_docs.roundtrip_check(rows, policy_docs.parse_policy_docs(policy_docs.render_policy_docs(rows)))


# Report tables


@query
def report_key_metrics(spark, sf_dir):
    claims = stored_claims(spark, sf_dir, FEATURE_COLUMNS)
    return report_tables.report_key_metrics(claims, detection.all_flags(stored_providers(claims)))


@query
def report_cost_histogram(spark, sf_dir):
    return report_tables.report_cost_histogram(order_claims(spark, sf_dir))


@query
def report_utilization_trend(spark, sf_dir):
    return report_tables.report_utilization_trend(order_claims(spark, sf_dir))


@query
def report_denial_funnel(spark, sf_dir):
    return report_tables.report_denial_funnel(order_claims(spark, sf_dir))


@query
def report_top_flags(spark, sf_dir):
    return report_tables.report_top_flags(detection.all_flags(providers(spark, sf_dir)))


@query
def flag_counts(spark, sf_dir):
    return report_tables.flag_counts(detection.all_flags(providers(spark, sf_dir)))


@query
def report_policy_impact(spark, sf_dir):
    return report_tables.report_policy_impact(stored_claims(spark, sf_dir, IMPACT_COLUMNS), EVENTS)


@query
def report_benchmarks(spark, sf_dir):
    return report_tables.report_benchmarks(order_claims(spark, sf_dir))


@query
def report_policy_insights(spark, sf_dir):
    claims = stored_claims(spark, sf_dir)
    return kpis.rank_policies(kpis_from_claims(claims, stored_rules(claims)))


@query
def match_counts(spark, sf_dir):
    claims = stored_claims(spark, sf_dir)
    return kpis.match_counts(kpis_from_claims(claims, stored_rules(claims)))


# Sinks, each table read back in full


def _written_features(name: str) -> Query:
    def run(spark, sf_dir):
        table = features.all_features(order_claims(spark, sf_dir))[name]
        return claim_tables.load_table(spark, claim_tables.write_features({name: table}, scratch_path(spark, "features"))[name])

    run.__name__ = f"write_features_{name}"
    return run


def _written_report(name: str) -> Query:
    def run(spark, sf_dir):
        table = QUERIES[name](spark, sf_dir)
        path = reports.write_reports({name: table}, scratch_path(spark, "reports"))[name]
        return spark.read.schema(table.schema).json(path)

    run.__name__ = f"write_reports_{name}"
    return run


for feature_set in ("claims", "provider", "temporal", "service_category"):
    query(_written_features(feature_set))
REPORTS = (
    "denial_categories", "top_appeal_providers", "benchmark_compare", "policy_impact", "all_flags", "validate_claims",
    "validate_issues", "policy_kpis",
)
for report_name in REPORTS:
    query(_written_report(report_name))
