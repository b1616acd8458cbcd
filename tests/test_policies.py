"""Seeds, documents, rules."""

import json
import os

import pytest

from conftest import by_key
from claimgauge.operators.policy_docs import parse_policy_docs, render_policy_docs, roundtrip_check
from claimgauge.operators.seeds import policy_seeds, sort_seeds
from claimgauge.operators.top_codes import top_k_codes
from claimgauge.sources import policies

SEEDS = (
    "procedure_code STRING, claim_type STRING, specialty STRING, n_claims BIGINT, approval_rate DOUBLE, "
    "denial_rate DOUBLE, avg_claim_amount DOUBLE, p50_claim_amount DOUBLE, p90_claim_amount DOUBLE, "
    "top_diagnosis_codes ARRAY<STRUCT<code: STRING, count: BIGINT>>"
)


@pytest.fixture(scope="module")
def two_groups(make_claims):
    a = [(41.0, "Y", ["N18.3", "E78.5"]), (47.5, "N", ["N18.3"]), (58.0, "N", ["E78.5"]), (66.5, "N", ["N18.3"]), (72.0, "N", ["Z79.4"])]
    b = [(910.0, "N", ["S82.0"]), (955.0, "N", ["S82.0"]), (990.0, "Y", ["S83.5"]), (1040.0, "N", ["S82.0"])]
    rows = [("CPT-83036", "Nephrology", *row) for row in a] + [("CPT-27447", "Orthopedics", *row) for row in b]
    return make_claims(
        *[
            {"procedure_code": code, "specialty": specialty, "allowed_amount": amount, "denial_flag": denied,
             "diagnosis_codes": json.dumps(codes)}
            for code, specialty, amount, denied, codes in rows
        ]
    )


@pytest.fixture(scope="module")
def seed_table(spark):
    rows = [
        ("CPT-99201", "Professional", "Internal Medicine", 1200, 0.85, 0.15, 108.0, 110.0, 1130.5, [("DX-001", 40), ("DX-002", 20)]),
        ("CPT-70100", "Institutional", "OB/GYN  ", 85, 1.0, 0.0, 390.0, 385.0, 420.0, []),
        ("HCPCS-E0100", "Professional", "DME Supplier", 30, 0.9, 0.1, 1.0, 1.0, 1.0, [("DX-1001", 3)]),
    ]
    return spark.createDataFrame(rows, SEEDS)


def test_seed_statistics(two_groups):
    seeds = by_key(policy_seeds(two_groups, min_claims=1), "procedure_code")
    a, b = seeds["CPT-83036"], seeds["CPT-27447"]
    assert (a["n_claims"], a["approval_rate"], a["denial_rate"], a["avg_claim_amount"]) == (5, 0.8, 0.2, 57.0)
    assert (a["p50_claim_amount"], a["p90_claim_amount"]) == (58.0, 72.0)
    # Index floor(3 * 0.5 + 0.5) = 2 of four.
    assert (b["p50_claim_amount"], b["p90_claim_amount"]) == (990.0, 1040.0)
    assert [tuple(x) for x in a["top_diagnosis_codes"]] == [("N18.3", 3), ("E78.5", 2), ("Z79.4", 1)]
    assert tuple(b["top_diagnosis_codes"][0]) == ("S82.0", 3)


def test_seed_limits_and_order(two_groups):
    assert [r["procedure_code"] for r in policy_seeds(two_groups, min_claims=5).collect()] == ["CPT-83036"]
    assert policy_seeds(two_groups, min_claims=100).count() == 0
    ordered = sort_seeds(policy_seeds(two_groups, min_claims=1, top_n_dx=1)).collect()
    assert [r["procedure_code"] for r in ordered] == ["CPT-27447", "CPT-83036"]
    assert [len(r["top_diagnosis_codes"]) for r in ordered] == [1, 1]


def test_seeds_of_null_keys_and_unreadable_codes(make_claims):
    claims = make_claims(
        {"specialty": None, "diagnosis_codes": "not json"},
        {"specialty": None, "diagnosis_codes": None, "allowed_amount": None},
        {"specialty": None, "diagnosis_codes": "[]"},
    )
    row = policy_seeds(claims, min_claims=3).collect()[0]
    assert (row["specialty"], row["n_claims"], row["p50_claim_amount"], row["top_diagnosis_codes"]) == (None, 3, 120.0, [])


def test_top_codes_break_ties_by_code(make_claims):
    claims = make_claims(*[{"diagnosis_codes": json.dumps(codes)} for codes in (["b", "c"], ["a"], ["b"], ["c", "a"])])
    row = top_k_codes(claims, ["provider_id"], 2).collect()[0]
    assert [tuple(x) for x in row["top_diagnosis_codes"]] == [("a", 2), ("b", 2)]


def test_document_text(seed_table):
    docs = by_key(render_policy_docs(seed_table), "file_name")
    assert set(docs) == {
        "POL_CPT_99201_Professional_Internal_Medicine.md",
        "POL_CPT_70100_Institutional_OB_GYN.md",
        "POL_HCPCS_E0100_Professional_DME_Supplier.md",
    }
    md = docs["POL_CPT_99201_Professional_Internal_Medicine.md"]["md"]
    assert md.startswith("# Prior Authorization Policy: CPT-99201\n\n**Specialty:** Internal Medicine\n")
    assert "- Requires documentation of Dx in [DX-001, DX-002].\n" in md
    assert "historical denial rate is 15.0%." in md and "routinely approved" not in md
    assert "(n=1,200):\n\n  - DX-001\n  - DX-002\n\n---" in md
    assert "| 90th Pct Claim Amount| $1,130.50 |\n| Approval Rate        | 85.0% |" in md
    md = docs["POL_CPT_70100_Institutional_OB_GYN.md"]["md"]
    assert "\n  - N/A\n" in md and "routinely approved" in md
    assert "Requires documentation" not in md and "historical denial rate" not in md
    assert md.endswith("analytical purposes only.*\n")


def test_last_of_colliding_names_stays(seed_table, spark):
    row = list(seed_table.where("procedure_code = 'CPT-99201'").collect()[0])
    both = spark.createDataFrame([tuple(row), tuple(["CPT 99201", *row[1:]])], SEEDS)
    docs = render_policy_docs(both).collect()
    assert len(docs) == 1 and docs[0]["md"].startswith("# Prior Authorization Policy: CPT-99201\n")


def test_parsed_rules(seed_table):
    rules = by_key(parse_policy_docs(render_policy_docs(seed_table)), "policy_id")
    rule = rules["POL_CPT_99201_Professional_Internal_Medicine"]
    # The year of the date is taken for a code; three-digit diagnosis numbers are not.
    assert rule["covered_cpt_codes"] == ["CPT-99201", "2024"]
    assert rule["site_of_service"] == "Professional"
    assert rule["diagnosis_constraints"] == ["DX-001", "DX-002"]
    assert len(rule["documentation_requirements"]) == 3
    assert rule["source_file"] == "POL_CPT_99201_Professional_Internal_Medicine.md"
    assert rules["POL_CPT_70100_Institutional_OB_GYN"]["diagnosis_constraints"] == []
    # Equipment codes are not recognized, digits of diagnosis codes are.
    assert rules["POL_HCPCS_E0100_Professional_DME_Supplier"]["covered_cpt_codes"] == ["2024", "1001"]


def test_free_text(spark):
    texts = {
        "empty.md": "",
        "other.md": "# Prior Authorization Policy:  X9 \n## 2. DIAGNOSIS context (all)\n* a \n  - n/a\n-b\n- c\n## Note\n- d\n## 3. More\n- e",
        "codes.md": "12345 123456 99213A CPT-9_1é 12345 x1234 1234",
    }
    docs = spark.createDataFrame(list(texts.items()), "file_name STRING, md STRING")
    rules = by_key(parse_policy_docs(docs), "policy_id")
    empty = rules["empty"]
    assert (empty["covered_cpt_codes"], empty["site_of_service"], empty["diagnosis_constraints"]) == ([], "", [])
    assert rules["other"]["diagnosis_constraints"] == ["a", "c", "d"]
    assert rules["other"]["documentation_requirements"] == []
    assert rules["codes"]["covered_cpt_codes"] == ["12345", "99213A", "CPT-9_1é", "1234"]
    unnamed = spark.createDataFrame([("", texts["other.md"])], "file_name STRING, md STRING")
    assert parse_policy_docs(unnamed).collect()[0]["policy_id"] == "X9"


def test_round_trip(seed_table):
    checked = by_key(roundtrip_check(seed_table, parse_policy_docs(render_policy_docs(seed_table))), "procedure_code")
    assert all(r["site_equal"] and r["diagnoses_found"] for r in checked.values())
    assert {code: r["code_found"] for code, r in checked.items()} == {
        "CPT-99201": True, "CPT-70100": True, "HCPCS-E0100": False,
    }


def test_files(seed_table, spark, tmp_path):
    docs = render_policy_docs(seed_table)
    policies.export_policy_files(docs, str(tmp_path / "docs"))
    exported = [name for name in os.listdir(tmp_path / "docs") if name.startswith("document=")]
    assert sorted(f"{name.removeprefix('document=')}.md" for name in exported) == sorted(r["file_name"] for r in docs.collect())
    assert sorted(policies.read_policy_files(spark, str(tmp_path / "docs")).collect()) == sorted(docs.select("file_name", "md").collect())
    path = policies.parse_policies_dir(spark, str(tmp_path / "docs"), str(tmp_path / "rules"))
    assert sorted(policies.load_policy_rules(spark, path).collect()) == sorted(parse_policy_docs(docs).collect())
    (tmp_path / "plain").mkdir()
    for r in docs.collect():
        (tmp_path / "plain" / r["file_name"]).write_text(r["md"], encoding="utf-8")
    (tmp_path / "plain" / "notes.txt").write_text("no policy")
    path = policies.parse_policies_dir(spark, str(tmp_path / "plain"), str(tmp_path / "rules2"))
    assert sorted(policies.load_policy_rules(spark, path).collect()) == sorted(parse_policy_docs(docs).collect())
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        policies.parse_policies_dir(spark, str(tmp_path / "nowhere"), str(tmp_path / "x"))


def test_rules_with_blank_lines(spark, tmp_path):
    file = tmp_path / "rules.jsonl"
    file.write_text('{"policy_id": "A", "covered_cpt_codes": ["1"]}\n\n{"policy_id": "B"}\n')
    rules = policies.load_policy_rules(spark, str(file)).collect()
    assert [(r["policy_id"], r["site_of_service"]) for r in rules] == [("A", None), ("B", None)]


def test_seed_files(two_groups, spark, tmp_path):
    parquet, lines = policies.write_policy_seeds(policy_seeds(two_groups, 1), str(tmp_path))
    assert {type(json.loads(r["top_diagnosis_codes"])) for r in spark.read.parquet(parquet).collect()} == {list}
    rows = [json.loads(r["value"]) for r in spark.read.text(lines).collect()]
    assert len(rows) == 2 and all(isinstance(r["top_diagnosis_codes"], list) for r in rows)
