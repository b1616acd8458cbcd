"""Policy files: one per seed, whole or not there at all."""

import os

import pytest
from pyspark.sql import functions as F

from claimgauge.operators.policy_docs import parse_policy_docs, render_policy_docs
from claimgauge.sources import policy_files

COLUMNS = (
    "procedure_code string, claim_type string, specialty string, n_claims long, approval_rate double, denial_rate double, "
    "avg_claim_amount double, p50_claim_amount double, p90_claim_amount double, "
    "top_diagnosis_codes array<struct<code: string, count: bigint>>"
)


@pytest.fixture
def seeds(spark):
    rows = [
        (f"CPT-{99000 + code}", kind, "Radio logy", 30 + code, 0.9, 0.1, 1.0, 2.0, 3.0, [("DX-1", 4)])
        for code in range(40)
        for kind in ("Professional", "Institutional")
    ]
    # Two seeds of one file name: the last in key order stays.
    rows += [("CPT 99001", "Professional", "Radio logy", 1, 0.5, 0.5, 1.0, 1.0, 1.0, [])]
    return spark.createDataFrame(rows, COLUMNS).repartition(4)


def test_one_file_per_seed_and_sorted_names(spark, seeds, tmp_path):
    folder = str(tmp_path / "policies")
    names = policy_files.write_policy_files(seeds, folder)
    assert names == sorted(names) == sorted(os.listdir(folder)) and len(names) == 80
    want = {r.file_name: r.md for r in render_policy_docs(seeds).collect()}
    got = {r.file_name: r.md for r in policy_files.read_written_files(spark, folder).collect()}
    assert got == want
    rules = parse_policy_docs(policy_files.read_written_files(spark, folder)).orderBy("source_file").collect()
    assert len(rules) == 80 and rules == parse_policy_docs(render_policy_docs(seeds)).orderBy("source_file").collect()


def test_writing_again_replaces_files_and_keeps_others(seeds, tmp_path):
    folder = tmp_path / "policies"
    folder.mkdir()
    (folder / "NOTES.md").write_text("mine")
    policy_files.write_policy_files(seeds, str(folder))
    names = policy_files.write_policy_files(seeds.where("claim_type = 'Professional'").withColumn("n_claims", F.lit(999).cast("long")), str(folder))
    assert len(names) == 40 and len(os.listdir(folder)) == 81
    assert (folder / "NOTES.md").read_text() == "mine" and "999" in (folder / names[0]).read_text()


def test_a_failed_task_leaves_no_file(seeds, tmp_path):
    folder = str(tmp_path / "policies")
    bad = seeds.withColumn("specialty", F.when(F.col("n_claims") == 45, F.raise_error(F.lit("broken seed"))).otherwise(F.col("specialty")))
    spark = seeds.sparkSession
    spark.dataSource.register(policy_files.policy_file_source())
    docs = bad.select("procedure_code", "claim_type", "specialty", F.col("procedure_code").alias("file_name"), F.lit("text").alias("md"))
    os.makedirs(folder)
    with pytest.raises(Exception, match="broken seed|abort"):
        docs.write.format("policy_files").mode("append").option("path", folder).save()
    assert os.listdir(folder) == []


def test_no_seeds(seeds, tmp_path):
    assert policy_files.write_policy_files(seeds.limit(0), str(tmp_path / "none")) == []
