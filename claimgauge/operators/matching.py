"""Claims matched to the policy rule that fits them best.

A rule scores 0.6 for the procedure code, 0.2 for the site of service and 0.2 for a shared
diagnosis code. With three yes/no parts, a claim's best rule is found by looking it up under every choice of
its code, its site and one of its diagnoses, in one index of the rules: each rule is listed there under every choice of
its own codes, site and diagnoses, and only the earliest rule of a choice is kept. A choice scores what its parts
score. The best-scoring choice found names the best rule, the earliest one where scores are equal: a rule that scores more
than the choice it was found under is also listed under a better choice of the claim's.

Claims are never paired with rules: only their distinct combinations of the three columns are looked
up, in one join, so the work grows with the combinations and the index entries. A choice such as the claim type
alone has few values, so the join is salted by the combination, and index rows repeated per salt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from claimgauge.functions.codes import diagnosis_list
from claimgauge.functions.text import strip
from claimgauge.operators.joins import join_groups

UNMATCHED = "unmatched"
UNNAMED = "unknown"

# Scores in tenths, so that their sums are exact.
CODE_TENTHS, SITE_TENTHS, DIAGNOSIS_TENTHS = 6, 2, 2

# Tasks over which the combinations of one key are spread, where the key has few values.
SALTS = 16

CLAIM_KEYS = ["procedure_code", "claim_type", "diagnosis_codes"]
PARTS = ["code", "site", "diagnosis"]


def match_score(pairs: DataFrame) -> DataFrame:
    """Add ``match_confidence`` to rows that hold a claim's and a rule's columns."""
    site = strip(F.coalesce("site_of_service", F.lit("")))
    fits = {
        CODE_TENTHS: F.array_contains("covered_cpt_codes", F.col("procedure_code")),
        SITE_TENTHS: (site != "") & (F.col("claim_type") == site),
    }
    shared = F.arrays_overlap("diagnosis_constraints", diagnosis_list(F.col("diagnosis_codes")))
    parts = [F.when(fit, tenths).otherwise(0) for tenths, fit in fits.items()]
    parts.append(F.when(shared, DIAGNOSIS_TENTHS).otherwise(0))
    return pairs.withColumn("match_confidence", reduce(lambda a, b: a + b, parts) / 10)


def _texts(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda value: value.isNotNull())


def _choices(df: DataFrame, keep: list[str | Column], codes: Column, sites: Column, diagnoses: Column) -> DataFrame:
    """Rows spread over all choices of parts, where null means that a part is not chosen."""
    nothing = F.array(F.lit(None).cast("string"))
    spread = df.select(*keep, codes.alias("codes"), sites.alias("sites"), diagnoses.alias("diagnoses"))
    for part, values in zip(PARTS, ("codes", "sites", "diagnoses")):
        spread = spread.withColumn(part, F.explode(F.array_union(values, nothing))).drop(values)
    return spread.where(F.coalesce(*PARTS).isNotNull())


def rule_index(rules: DataFrame, order_by: str) -> DataFrame:
    """The earliest rule (``place, policy_id``) per choice of its code, site and diagnosis."""
    best = F.struct(F.col(order_by).alias("place"), F.coalesce("policy_id", F.lit(UNNAMED)).alias("policy_id"))
    site = strip(F.coalesce("site_of_service", F.lit("")))
    listed = _choices(
        rules,
        [best.alias("best")],
        _texts(F.col("covered_cpt_codes")),
        F.filter(F.array(site), lambda value: value != ""),
        _texts(F.col("diagnosis_constraints")),
    )
    return listed.groupBy(*PARTS).agg(F.min("best").alias("best"))


def _best_of_combinations(combos: DataFrame, index: DataFrame) -> DataFrame:
    """``policy_id`` and ``match_confidence`` of the distinct combinations that fit a rule."""
    salt = F.pmod(F.xxhash64(*CLAIM_KEYS), F.lit(SALTS)).cast("int").alias("salt")
    looked_up = _choices(
        combos,
        [*CLAIM_KEYS, salt],
        _texts(F.array("procedure_code")),
        _texts(F.array("claim_type")),
        _texts(diagnosis_list(F.col("diagnosis_codes"))),
    )
    salted = index.select(*[F.col(part).alias(f"index_{part}") for part in PARTS], "best").withColumn(
        "index_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    )
    same = [F.col(part).eqNullSafe(F.col(f"index_{part}")) for part in PARTS]
    scores = zip(PARTS, (CODE_TENTHS, SITE_TENTHS, DIAGNOSIS_TENTHS))
    tenths = reduce(lambda a, b: a + b, [F.when(F.col(part).isNotNull(), score).otherwise(0) for part, score in scores])
    fit = F.struct((-tenths).alias("order"), "best.place", "best.policy_id")
    return (
        looked_up.join(salted, reduce(lambda a, b: a & b, same, F.col("salt") == F.col("index_salt")))
        .groupBy(*CLAIM_KEYS)
        .agg(F.min(fit).alias("fit"))
        .select(*CLAIM_KEYS, "fit.policy_id", (-F.col("fit.order") / 10).alias("match_confidence"))
    )


def match_claims_to_policies(claims: DataFrame, rules: DataFrame, order_by: str = "source_file") -> DataFrame:
    """Claims with ``policy_id`` and ``match_confidence`` of the best rule.

    Of equally good rules the first by ``order_by`` wins. Claims that no rule fits are
    ``unmatched`` with confidence 0. Duplicate claims stay. Nothing runs before an action; derived rules are better
    stored first, so that their size is known when the join is planned.
    """
    combos = claims.select(*CLAIM_KEYS).distinct()
    matched = join_groups(claims, _best_of_combinations(combos, rule_index(rules, order_by)), CLAIM_KEYS)
    return matched.withColumns(
        {"policy_id": F.coalesce("policy_id", F.lit(UNMATCHED)), "match_confidence": F.coalesce("match_confidence", F.lit(0.0))}
    )
