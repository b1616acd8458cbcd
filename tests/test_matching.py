"""Matching against brute force, and KPIs."""

import json
import random

import pytest

from conftest import by_key
from claimgauge.operators.kpis import match_counts, policy_kpis, rank_policies, sort_kpis
from claimgauge.operators.matching import match_claims_to_policies, match_score
from claimgauge.schema import POLICY_RULE

RULE = {"covered_cpt_codes": [], "site_of_service": "", "diagnosis_constraints": [], "documentation_requirements": []}


def table(spark, rules):
    rows = [{**RULE, "source_file": f"{i:04}", **rule} for i, rule in enumerate(rules)]
    return spark.createDataFrame([tuple(r.get(n) for n in POLICY_RULE.names) for r in rows], POLICY_RULE)


def expected(claim, rules):
    """The definition, rule by rule: the first of the highest scores."""
    best = ("unmatched", 0)
    try:
        codes = set(json.loads(claim["diagnosis_codes"]))
    except (TypeError, ValueError):
        codes = set()
    for rule in rules:
        site = (rule.get("site_of_service") or "").strip()
        score = 6 * (claim["procedure_code"] in (rule.get("covered_cpt_codes") or []))
        score += 2 * bool(site and site == claim["claim_type"])
        score += 2 * bool(codes & set(rule.get("diagnosis_constraints") or []))
        if score > best[1]:
            best = (rule.get("policy_id") or "unknown", score)
    return best[0], best[1] / 10


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(spark, make_claims, seed):
    rng = random.Random(seed)
    codes, sites, diagnoses = ["A", "B", "C", "D"], ["S", "T", "U"], [f"x{i}" for i in range(60)]

    def some(values, most):
        return rng.sample(values, rng.randint(0, most))

    rules = [
        {
            "policy_id": f"R{i}" if rng.random() < 0.9 else None,
            "covered_cpt_codes": some(codes[:3], 2) if rng.random() < 0.9 else None,
            "site_of_service": rng.choice(["", " S ", "T\n", "V", None]),
            "diagnosis_constraints": some(diagnoses[:50], 30 if seed == 1 else 3) if rng.random() < 0.9 else None,
        }
        for i in range(25)
    ]
    claims = [
        {
            "procedure_code": rng.choice([*codes, None]),
            "claim_type": rng.choice([*sites, None]),
            "diagnosis_codes": rng.choice(["[]", "oops", None, *[json.dumps(some(diagnoses, 3)) for _ in range(9)]]),
        }
        for _ in range(300)
    ]
    matched = match_claims_to_policies(make_claims(*claims), table(spark, rules))
    got = {r["claim_id"]: (r["policy_id"], r["match_confidence"]) for r in matched.collect()}
    assert got == {f"C{i}": expected(claim, rules) for i, claim in enumerate(claims, 1)}


def test_no_rules_and_duplicate_claims(spark, make_claims):
    claims = make_claims({"claim_id": "X"}, {"claim_id": "X"})
    matched = match_claims_to_policies(claims, table(spark, [])).collect()
    assert [(r["claim_id"], r["policy_id"], r["match_confidence"]) for r in matched] == [("X", "unmatched", 0.0)] * 2
    assert match_claims_to_policies(claims.limit(0), table(spark, [])).count() == 0


def test_scores(spark, make_claims):
    rule = {"policy_id": "R", "covered_cpt_codes": ["CPT-99201"], "site_of_service": "Professional ", "diagnosis_constraints": ["DX-1"]}
    claims = make_claims(
        {},
        {"claim_type": "Institutional", "diagnosis_codes": '["DX-9"]'},
        {"procedure_code": "CPT-1", "claim_type": "Institutional", "diagnosis_codes": '["DX-9"]'},
        {"procedure_code": "CPT-1", "diagnosis_codes": "[]"},
        {"procedure_code": "CPT-1", "claim_type": "Institutional"},
        {"procedure_code": None, "claim_type": None, "diagnosis_codes": None},
    )
    pairs = claims.join(table(spark, [rule]).select("covered_cpt_codes", "site_of_service", "diagnosis_constraints"))
    scores = [r["match_confidence"] for r in match_score(pairs).orderBy("claim_id").collect()]
    assert scores == [1.0, 0.6, 0.0, 0.2, 0.2, 0.0]


def test_the_first_of_equal_rules_wins(spark, make_claims):
    rules = [{"policy_id": name, "site_of_service": "Professional", "source_file": name} for name in ("b", "a", "c")]
    matched = match_claims_to_policies(make_claims({}), table(spark, rules))
    assert matched.collect()[0]["policy_id"] == "a"


def test_no_pairing_and_no_job_before_the_action(spark, make_claims, tmp_path):
    make_claims({}, {}).write.parquet(str(tmp_path / "claims"))
    claims = spark.read.parquet(str(tmp_path / "claims"))
    rules = table(spark, [{"policy_id": "R", "covered_cpt_codes": ["CPT-99201"], "diagnosis_constraints": ["DX-1"]}])
    spark.sparkContext.setJobGroup("building", "no job while a plan is built")
    matched = match_claims_to_policies(claims, rules)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "Subquery"):
        assert operator not in plan
    # One join with the index, one that hands the results to the claims.
    assert plan.count("HashJoin") + plan.count("SortMergeJoin") == 2


def test_the_same_with_shuffled_joins(spark, make_claims):
    """Half of the claims are alike, null parts meet nothing, and no table is broadcast."""
    claims = [
        {"procedure_code": "A" if i % 2 else None, "claim_type": "S" if i % 2 else None, "diagnosis_codes": "[]" if i % 2 else f'["x{i % 7}", null]'}
        for i in range(100)
    ]
    rules = [
        {"policy_id": "none", "covered_cpt_codes": [None], "diagnosis_constraints": [None, "x1"]},
        {"policy_id": "site", "site_of_service": " S", "diagnosis_constraints": ["x2", "x2"]},
        {"policy_id": "code", "covered_cpt_codes": ["A", "A", None]},
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matched = match_claims_to_policies(make_claims(*claims), table(spark, rules)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r["claim_id"]: (r["policy_id"], r["match_confidence"]) for r in matched}
    plain = [{**rule, "covered_cpt_codes": [c for c in rule.get("covered_cpt_codes", []) if c],
              "diagnosis_constraints": [d for d in rule.get("diagnosis_constraints", []) if d]} for rule in rules]
    assert got == {f"C{i}": expected(claim, plain) for i, claim in enumerate(claims, 1)}


@pytest.fixture(scope="module")
def kpis(spark, make_claims):
    from pyspark.sql import functions as F

    rows = [
        ("A", {"allowed_amount": 75.5, "diagnosis_codes": '["R07.9", "I20.0"]'}),
        ("A", {"allowed_amount": 24.5, "denial_flag": "Y", "specialty": "", "diagnosis_codes": '["R07.9"]'}),
        ("B", {"allowed_amount": 0.0, "billed_amount": 1310.0, "specialty": "Urology", "diagnosis_codes": "oops"}),
        ("B", {"allowed_amount": None, "billed_amount": 0.0, "specialty": None, "diagnosis_codes": None, "denial_flag": None}),
        ("unmatched", {"allowed_amount": 8.0}),
    ]
    claims = make_claims(*[row for _, row in rows])
    names = F.create_map(*[x for i, (name, _) in enumerate(rows, 1) for x in (F.lit(f"C{i}"), F.lit(name))])
    return policy_kpis(claims.withColumn("policy_id", names[F.col("claim_id")]))


def test_kpis(kpis):
    got = by_key(kpis, "policy_id")
    assert tuple(got["A"])[1:] == (2, 100.0, 50.0, 0.5, 0.5, ["R07.9", "I20.0"], ["Internal Medicine"])
    # An allowed amount of 0 counts as missing; a null denial flag as approved.
    assert tuple(got["B"])[1:] == (2, 1310.0, 655.0, 1.0, 0.0, [], ["Urology"])
    assert [r["policy_id"] for r in sort_kpis(kpis).collect()] == ["B", "A", "unmatched"]
    assert tuple(match_counts(kpis).collect()[0]) == (5, 4, 1)


def test_ranked_table(kpis):
    rows = rank_policies(kpis).orderBy("place").collect()
    assert tuple(rows[0]) == (1, "B", "2", "$1,310.00", "$655.00", "100.00%", "0.00%", "—", "Urology")
    assert [r["policy_id"] for r in rank_policies(kpis, "denial_rate").orderBy("place").collect()] == ["A", "B", "unmatched"]
    with pytest.raises(ValueError):
        rank_policies(kpis, "n_claims")


def test_kpis_of_nothing(spark, make_claims):
    from pyspark.sql import functions as F

    assert policy_kpis(make_claims({}).limit(0).withColumn("policy_id", F.lit("A"))).count() == 0
