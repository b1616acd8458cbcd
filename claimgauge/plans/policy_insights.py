"""From claims to policies and back: seeds, documents, rules, matched claims, KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimgauge.operators.kpis import match_counts, policy_kpis, rank_policies, sort_kpis
from claimgauge.operators.matching import match_claims_to_policies
from claimgauge.operators.policy_docs import parse_policy_docs, render_policy_docs
from claimgauge.operators.seeds import policy_seeds
from claimgauge.operators.stages import materialize, owned_stages
from claimgauge.sources.claims import load_claims
from claimgauge.sources.policies import load_policy_rules
from claimgauge.sources.reports import write_reports


def rules_from_claims(claims: DataFrame, min_claims: int = 30) -> DataFrame:
    """The rules of the policies that the claims themselves suggest."""
    return parse_policy_docs(render_policy_docs(policy_seeds(claims, min_claims)))


def kpis_from_claims(claims: DataFrame, rules: DataFrame) -> DataFrame:
    return policy_kpis(match_claims_to_policies(claims, rules))


def policy_insights(
    spark: SparkSession, claims_path: str, rules_path: str, output: str, rank_by: str = "total_amount"
) -> dict[str, str]:
    """Match stored claims to stored rules; write KPIs, the ranked table and match counts."""
    with owned_stages(spark):
        kpis = materialize(kpis_from_claims(load_claims(spark, claims_path), load_policy_rules(spark, rules_path)), "kpis")
        return write_reports(
            {
                "policy_kpis": sort_kpis(kpis),
                "report_policy_insights": rank_policies(kpis, rank_by),
                "match_counts": match_counts(kpis),
            },
            output,
        )
