"""Per-policy roll-ups of matched claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimgauge.functions import money
from claimgauge.functions.codes import diagnosis_list
from claimgauge.functions.ratios import count_where, rate
from claimgauge.functions.text import grouped, percent
from claimgauge.operators.order_stats import number_rows
from claimgauge.operators.matching import UNMATCHED

TOP = 5
SHOWN = 3
NOTHING = "—"
RANKINGS = ("total_amount", "denial_rate")


def claim_amount() -> Column:
    """The allowed amount, else the billed one, else 0; an amount of 0 counts as missing."""
    return F.coalesce(
        F.nullif(F.col("allowed_amount"), F.lit(0.0)), F.nullif(F.col("billed_amount"), F.lit(0.0)), F.lit(0.0)
    )


def policy_kpis(matched: DataFrame) -> DataFrame:
    """One row per policy with volume, amounts, rates and its most frequent codes and specialties.

    Matching is the costly part of such a plan, so claims are read once: each one yields an entry
    for its specialty, with the amounts, and one per diagnosis code. Entries are summed on the map
    side, which leaves a row per policy and code, however many claims a policy holds.
    """
    nothing = F.lit(None)
    by_specialty = F.struct(
        F.lit("specialty").alias("kind"),
        F.col("specialty").alias("code"),
        claim_amount().alias("amount"),
        (F.col("denial_flag") == "Y").alias("denied"),
    )
    by_diagnosis = F.transform(
        F.coalesce(diagnosis_list(F.col("diagnosis_codes")), F.array().cast("array<string>")),
        lambda code: F.struct(
            F.lit("diagnosis").alias("kind"),
            code.alias("code"),
            nothing.cast("double").alias("amount"),
            nothing.cast("boolean").alias("denied"),
        ),
    )
    counted = (
        matched.select("policy_id", F.explode(F.concat(F.array(by_specialty), by_diagnosis)).alias("entry"))
        .groupBy("policy_id", "entry.kind", "entry.code")
        .agg(
            F.count("*").alias("n"),
            *money.sum_parts("entry.amount", "amount"),
            count_where(F.col("entry.denied")).alias("denials"),
        )
    )
    named = F.coalesce(F.col("code"), F.lit("")) != ""
    place = F.row_number().over(Window.partitionBy("policy_id", "kind").orderBy(F.desc(named), F.desc("n"), "code"))
    shown = named & (F.col("place") <= TOP)
    claims = F.col("kind") == "specialty"

    def top(condition: Column) -> Column:
        places = F.collect_list(F.when(shown & condition, F.struct("place", "code")))
        return F.transform(F.array_sort(places), lambda x: x["code"])

    n, denials = F.col("n_claims"), F.col("denials")
    return (
        counted.withColumn("place", place)
        .groupBy("policy_id")
        .agg(
            F.sum(F.when(claims, F.col("n"))).alias("n_claims"),
            *money.merge_parts("amount"),
            F.sum("denials").alias("denials"),
            top(~claims).alias("top_dx"),
            top(claims).alias("top_specialties"),
        )
        .select(
            "policy_id",
            "n_claims",
            F.round(money.total("amount"), 2).alias("total_amount"),
            F.round(rate(money.total("amount"), n), 2).alias("avg_amount"),
            F.round(rate(n - denials, n), 4).alias("approval_rate"),
            F.round(rate(denials, n), 4).alias("denial_rate"),
            "top_dx",
            "top_specialties",
        )
    )


def sort_kpis(kpis: DataFrame) -> DataFrame:
    return kpis.orderBy(F.desc("total_amount"), "policy_id")


def rank_policies(kpis: DataFrame, rank_by: str = "total_amount") -> DataFrame:
    """Numbered policies, highest first, with display texts.

    Policies are sorted by range over all tasks, in a stored stage.
    """
    if rank_by not in RANKINGS:
        raise ValueError(f"rank_by must be one of {RANKINGS}, not {rank_by!r}")
    placed = number_rows(kpis, [F.desc(rank_by), F.asc("policy_id")], "place")

    def first_three(name: str) -> Column:
        joined = F.array_join(F.slice(name, 1, SHOWN), ", ")
        return F.when(joined == "", NOTHING).otherwise(joined)

    return placed.select(
        "place",
        "policy_id",
        grouped(F.col("n_claims")).alias("claims"),
        F.concat(F.lit("$"), grouped(F.col("total_amount"), 2)).alias("total_amount"),
        F.concat(F.lit("$"), grouped(F.col("avg_amount"), 2)).alias("avg_amount"),
        percent(F.col("approval_rate"), 2).alias("approval_rate"),
        percent(F.col("denial_rate"), 2).alias("denial_rate"),
        first_three("top_dx").alias("top_dx"),
        first_three("top_specialties").alias("top_specialties"),
    )


def match_counts(kpis: DataFrame) -> DataFrame:
    """One row: claims with and without a policy."""
    matched = F.col("policy_id") != UNMATCHED
    return kpis.agg(
        F.coalesce(F.sum("n_claims"), F.lit(0)).alias("claims"),
        F.coalesce(F.sum(F.when(matched, F.col("n_claims"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(~matched, F.col("n_claims"))), F.lit(0)).alias("unmatched"),
    )
