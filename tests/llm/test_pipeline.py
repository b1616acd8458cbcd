"""The whole pipeline against a plain version of each stage on the driver's small tables."""

import os

import pytest

import corpus_pipeline
from claimgauge.llm import decontaminate, language_id, quality_rules, simhash_dedup
from test_packing import check_pieces
from test_simhash_dedup import plain_components, plain_fingerprint
from test_decontaminate import plain

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def test_rows_of_every_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, SF_DIR), "test-stage")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    judged = {r.doc_id: r.kept for r in quality_rules.op9_quality_rules(spark, SF_DIR).collect()}
    assert kept["quality_rules"] == {i: t for i, t in whole.items() if judged[i]}
    assert kept["language_id"].keys() <= kept["quality_rules"].keys()
    label = plain_components([(i, plain_fingerprint(t)) for i, t in kept["language_id"].items()])
    assert kept["near_duplicates"] == {i: t for i, t in kept["language_id"].items() if label[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {i for i, _, _, _, bad in plain(sorted(kept["near_duplicates"].items()), items) if not bad}
    assert set(kept["decontamination"]) == clean
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    assert check_pieces(pieces, kept["decontamination"]) == 0


def test_stages_are_the_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "decontamination", "packing"]
    assert {f.__module__ for _, f in corpus_pipeline.STAGES} >= {m.__name__ for m in (quality_rules, language_id, simhash_dedup, decontaminate)}
