"""Policy seeds: claims clustered by procedure code, claim type and specialty."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimgauge.functions import money
from claimgauge.functions.ratios import count_where, ratio
from claimgauge.operators.joins import join_groups
from claimgauge.operators.order_stats import nearest_quantiles
from claimgauge.operators.stages import materialize
from claimgauge.operators.top_codes import top_k_codes
from claimgauge.schema import CODE_COUNTS

KEYS = ["procedure_code", "claim_type", "specialty"]
QUANTILES = {"p50_claim_amount": 0.5, "p90_claim_amount": 0.9}


def policy_seeds(claims: DataFrame, min_claims: int = 30, top_n_dx: int = 5) -> DataFrame:
    """One row per cluster of at least ``min_claims`` claims, unsorted.

    The first pass counts and sums per cluster and stores the clusters that are large enough; quantiles
    and codes are then looked for in those clusters only. Calling it runs these jobs.
    """
    stats = materialize(
        claims.groupBy(*KEYS)
        .agg(
            F.count("*").alias("n"),
            F.count("allowed_amount").alias("n_amount"),
            count_where(F.col("denial_flag") == "N").alias("approved"),
            count_where(F.col("denial_flag") == "Y").alias("denied"),
            F.count("denial_flag").alias("n_flag"),
            *money.sum_parts("allowed_amount", "allowed"),
        )
        .where(F.col("n") >= min_claims),
        "large-clusters",
    )
    kept = join_groups(claims.select(*KEYS, "allowed_amount", "diagnosis_codes"), stats.select(*KEYS), KEYS, "left_semi")
    quantiles = nearest_quantiles(kept, KEYS, "allowed_amount", QUANTILES)
    joined = join_groups(join_groups(stats, quantiles, KEYS), top_k_codes(kept, KEYS, top_n_dx), KEYS)
    return joined.select(
        *KEYS,
        F.col("n").alias("n_claims"),
        ratio(F.col("approved"), F.col("n_flag")).alias("approval_rate"),
        ratio(F.col("denied"), F.col("n_flag")).alias("denial_rate"),
        ratio(money.total("allowed"), F.col("n_amount")).alias("avg_claim_amount"),
        *QUANTILES,
        F.coalesce("top_diagnosis_codes", F.array().cast(CODE_COUNTS)).alias("top_diagnosis_codes"),
    )


def sort_seeds(seeds: DataFrame) -> DataFrame:
    return seeds.orderBy(*KEYS)
