"""External CSV files, parquet round trips, whole runs, streams."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import by_key
from claimgauge import streaming
from claimgauge.config import PipelineConfig, PolicyChangeEvent
from claimgauge.operators.stages import shared_folder
from claimgauge.operators.validation import validate_claims, validate_issues
from claimgauge.plans.pipeline import ValidationFailed, run_all
from claimgauge.plans.policy_insights import policy_insights, rules_from_claims
from claimgauge.schema import CLAIMS
from claimgauge.sources.claims import load_claims, save_claims
from claimgauge.sources.external_csv import EXTERNAL_COLUMNS, load_external_csv, read_external_csv
from claimgauge.sources.policies import write_policy_rules

HEADER = " ClaimID,PatientID ,ProviderID,ClaimAmount,ClaimDate,DiagnosisCode,ProcedureCode,ProviderSpecialty,ClaimType,ClaimStatus,Extra"
LINES = [
    "ext-07,m-31,doc 4,640.40,2022-08-09,M54.5,97110,Physical Therapy,Professional,Approved,",
    "ext-08,m-32,doc 4,75.00,2022-11-30,H52.1,92014,Optometry,PROFESSIONAL,denied,note",
    'ext-09,m-33,doc 9,9120.80,31.12.2022,"",33533,Cardiac Surgery,institutional care,Approved,',
    "ext-10,m-33,doc 2,12.25,2023-01-02,,J1100,Oncology,Specialty Pharmacy,Pending,",
    "ext-11,m-34,doc 2,480,2023-02-14,K21.9,43239,Gastroenterology,,REJECTED,",
    "ext-12,m-35,doc 2,,2023-02-14,K21.9,43239,Gastroenterology,Vision,,",
]


@pytest.fixture
def csv(tmp_path):
    def write(*lines):
        path = tmp_path / "claims.csv"
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    return write


def test_external_csv(spark, csv):
    claims = load_external_csv(spark, csv(HEADER, *LINES))
    assert [(f.name, f.dataType) for f in claims.schema] == [(f.name, f.dataType) for f in CLAIMS]
    got = by_key(claims, "claim_id")
    assert len(got) == 6
    first = got["ext-07"]
    assert (first["service_date"], first["paid_date"]) == (dt.date(2022, 8, 9), dt.date(2022, 9, 8))
    assert (first["billed_amount"], first["allowed_amount"], first["paid_amount"]) == (640.4, 640.4 * 0.8, 640.4 * 0.7)
    assert first["diagnosis_codes"] == '["M54.5"]' and first["units"] == 1 and first["payer_product"] == "Commercial"
    denied = got["ext-08"]
    assert (denied["denial_flag"], denied["denial_reason_category"]) == ("Y", "medical_necessity")
    assert (denied["paid_amount"], denied["paid_date"], denied["allowed_amount"]) == (0.0, None, 60.0)
    assert got["ext-09"]["service_date"] is None and got["ext-09"]["paid_date"] is None
    assert [got[key]["claim_type"] for key in sorted(got)] == [
        "Professional", "Professional", "Institutional", "Pharmacy", "Professional", "Professional",
    ]
    # Quoted and empty is a code that is not known, an empty field is none at all.
    assert [got[key]["diagnosis_codes"] for key in ("ext-09", "ext-10")] == ['["UNKNOWN"]', None]
    assert got["ext-11"]["denial_flag"] == "Y" and got["ext-12"]["denial_flag"] == "N" and got["ext-12"]["billed_amount"] is None


def test_external_claims_pass_validation(spark, csv):
    assert validate_claims(load_external_csv(spark, csv(HEADER, *LINES[:2]))).collect()[0]["passed"]


def test_bad_external_files(spark, csv, tmp_path):
    with pytest.raises(ValueError, match="Missing required columns.*ClaimAmount"):
        read_external_csv(spark, csv("ClaimID,Other", "1,2"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_external_csv(spark, csv(HEADER, LINES[0].replace("640.40", "many"))).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_external_csv(spark, str(tmp_path / "nowhere.csv"))


@pytest.mark.parametrize(
    "row",
    [
        LINES[0] + ",one more",
        "ext-07,m-31,doc 4,640.40,2022-08-09,M54.5,97110,Physical Therapy",
        'ext-07,m-31,doc 4,640.40,2022-08-09,M54.5,97110,"Physical\nTherapy",Professional,Approved,x',
    ],
)
def test_irregular_rows_fail(spark, csv, row):
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        load_external_csv(spark, csv(HEADER, *LINES, row)).collect()


def test_quoted_fields(spark, csv):
    row = 'ext-07,"m ""31""","doc, 4",640.40,2022-08-09,M54.5,97110,"Physical\nTherapy",Professional,Approved,x'
    got = load_external_csv(spark, csv(HEADER, row), multi_line=True).collect()
    assert [(r["member_id"], r["provider_id"], r["specialty"]) for r in got] == [('m "31"', "doc, 4", "Physical\nTherapy")]


def test_files_with_different_headers_fail(spark, tmp_path):
    swapped = HEADER.replace(" ClaimID,PatientID ", "PatientID,ClaimID")
    for name, header in (("a.csv", HEADER), ("b.csv", swapped)):
        (tmp_path / name).write_text(header + "\n" + LINES[0] + "\n")
    with pytest.raises(Exception, match="[Hh]eader"):
        load_external_csv(spark, str(tmp_path / "*.csv")).collect()


def test_claims_keep_the_columns_of_their_files(spark, five_claims, tmp_path):
    changed = five_claims.drop("facility_id", "units").withColumn("note", F.lit(None).cast("string")).withColumn("paid_amount", F.lit(1))
    claims = load_claims(spark, save_claims(changed, str(tmp_path / "claims")))
    assert set(claims.columns) == set(changed.columns) and claims.columns[-1] == "note"
    assert claims.schema["paid_amount"].dataType == CLAIMS["paid_amount"].dataType
    with pytest.raises(ValidationFailed, match="1 critical"):
        run_all(spark, str(tmp_path / "claims"), str(tmp_path / "out"))
    assert read(spark, str(tmp_path / "out/validation_issues.json"))[0]["rule"] == "column_presence"
    extra = save_claims(five_claims.withColumn("note", F.lit(None).cast("string")), str(tmp_path / "extra"))
    assert "Column 'note' has 100.0% nulls" in [r["message"] for r in validate_issues(load_claims(spark, extra)).collect()]


def test_claims_round_trip(spark, five_claims, tmp_path):
    path = save_claims(five_claims, str(tmp_path / "deep" / "claims"))
    assert sorted(map(str, load_claims(spark, path).collect())) == sorted(map(str, five_claims.collect()))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_claims(spark, str(tmp_path / "nowhere"))
    (tmp_path / "text.parquet").write_text("this is no parquet file")
    with pytest.raises(Exception):
        load_claims(spark, str(tmp_path / "text.parquet")).collect()


def test_filters_reach_the_reader(spark, five_claims, tmp_path):
    from claimgauge.operators.policy_events import policy_impact

    path = save_claims(five_claims, str(tmp_path / "claims"))
    event = PolicyChangeEvent("E", ("CPT-7",), "removed", dt.date(2023, 2, 10))
    impact = policy_impact(load_claims(spark, path), [event])
    plan = spark._jvm.PythonSQLUtils.explainString(impact._jdf.queryExecution(), "formatted")
    pushed = plan[plan.index("PushedFilters") :].splitlines()[0]
    assert "StringStartsWith(procedure_code,CPT-7)" in pushed and "GreaterThanOrEqual(service_date" in pushed
    schema = plan[plan.index("ReadSchema") :].splitlines()[0]
    assert "member_id" not in schema and "diagnosis_codes" not in schema


def read(spark, path):
    return [json.loads(r["value"]) for r in spark.read.text(path).collect()]


def stored_tables(spark):
    folder = os.path.join(shared_folder(spark).removeprefix("file://"), "claimgauge")
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def test_full_run(spark, five_claims, tmp_path):
    claims = save_claims(five_claims, str(tmp_path / "claims"))
    config = PipelineConfig(
        policy_events=(PolicyChangeEvent("E", ("CPT",), "removed", dt.date(2023, 2, 20), "all visits"),)
    )
    before = stored_tables(spark)
    written = run_all(spark, claims, str(tmp_path / "out"), config)
    assert stored_tables(spark) == before
    assert {name for name in written if name.startswith("report_")} == {
        "report_key_metrics", "report_cost_histogram", "report_utilization_trend", "report_denial_funnel",
        "report_flag_counts", "report_top_flags", "report_policy_impact", "report_benchmarks",
    }
    assert all(os.path.isdir(path) for path in written.values())
    assert spark.read.parquet(written["provider"]).count() == 3
    assert read(spark, written["appeals_report"])[0]["total_denials"] == 1
    assert [r["metric_name"] for r in read(spark, written["benchmark_report"])] == ["denial_rate", "oon_rate", "cost_per_claim"]
    assert read(spark, written["policy_impact"])[0]["pre_volume"] == 1
    metrics = {r["metric"]: r["value"] for r in read(spark, written["report_key_metrics"])}
    assert metrics["total_billed"] == 4112.0 and metrics["total_flags"] == 0


def test_run_stops_at_critical_issues(spark, make_claims, tmp_path):
    claims = save_claims(make_claims({"units": 0}), str(tmp_path / "claims"))
    with pytest.raises(ValidationFailed, match="1 critical"):
        run_all(spark, claims, str(tmp_path / "out"))
    assert [r["rule"] for r in read(spark, str(tmp_path / "out/validation_issues.json")) if r["level"] == "critical"] == [
        "positive_units"
    ]


def test_policy_insights(spark, make_claims, tmp_path):
    rows = [{"procedure_code": "CPT-99201"}] * 3 + [{"procedure_code": "CPT-70100", "claim_type": "Pharmacy", "diagnosis_codes": "[]"}]
    claims = save_claims(make_claims(*rows), str(tmp_path / "claims"))
    rules = write_policy_rules(rules_from_claims(load_claims(spark, claims), 2), str(tmp_path / "rules"))
    written = policy_insights(spark, claims, rules, str(tmp_path / "out"), "denial_rate")
    assert read(spark, written["match_counts"]) == [{"claims": 4, "matched": 3, "unmatched": 1}]
    kpis = read(spark, written["policy_kpis"])
    assert [k["policy_id"] for k in kpis] == ["POL_CPT_99201_Professional_Internal_Medicine", "unmatched"]


def test_row_by_row_operators_accept_streams(spark, make_claims, tmp_path):
    claims = make_claims({"units": 0}, {"procedure_code": "CPT-70100"})
    claims.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CLAIMS).parquet(str(tmp_path / "in"))

    def both(df):
        return streaming.route_valid_rows(streaming.tag_service_category(df))

    query = both(stream).writeStream.format("memory").queryName("routed").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.table("routed").collect())) == sorted(map(str, both(claims).collect()))


def test_the_library_has_no_python_functions_in_its_plans():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "claimgauge")
    for folder, _, files in os.walk(root):
        for file in files:
            if file.endswith(".py"):
                with open(os.path.join(folder, file), encoding="utf-8") as source:
                    text = source.read()
                if os.path.basename(folder) == "llm":
                    continue  # its operators choose their style one by one
                for word in (".collect()", "udf(", "mapInPandas", "applyInPandas", "toPandas", "localCheckpoint", "crossJoin"):
                    assert word not in text, (file, word)


def test_external_columns_are_the_documented_ones():
    assert len(EXTERNAL_COLUMNS) == len(set(EXTERNAL_COLUMNS)) == 10
