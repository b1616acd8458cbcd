"""Language identification: features, machines, held-out accuracy."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgauge.llm import language_id as li

SYLLABLES = {"en": "the ing and er", "de": "sch ung ich der", "fr": "eau les tion une", "es": "ado que ión los", "xx": "qqq kkk zzz www"}


def sentence(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def labelled(n=60):
    rng = random.Random(12)
    return [(i, sentence(rng, lang, rng.randrange(5, 40)), lang) for i, lang in enumerate(list(SYLLABLES) * n)]


def test_features_count_all_grams_of_the_whole_text(monkeypatch):
    text = "Ab, cd! " * 50
    whole = li.features(text)
    monkeypatch.setattr(li, "CHUNK", 16)
    assert np.allclose(li.features(text), whole)
    assert abs(float((whole**2).sum()) - 1) < 1e-3
    assert all(li.features(t) is None for t in (None, "", " 12 .,", "_-"))
    assert li.features("é") is not None


def test_machine_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    positive = x[:, 2] + 0.5 * x[:, 0] > 0
    w = li.train_machine(x, positive)
    assert ((x @ w > 0) == positive).mean() > 0.97


def test_learns_languages_and_answers_every_row(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, lang, 1.0) for i, t, lang in rows], "doc_id long, text string, lang string, score double").repartition(3)
    model = li.learned_model(docs)
    assert model.families == ("germanic", "romance", "xx")
    odd = [(1000, None, None), (1001, "", "en"), (1002, "123 ...", "en"), (None, rows[0][1], None), (5, rows[5][1], "en"), (1003, "the " * 300000, "en")]
    more = docs.union(spark.createDataFrame([(i, t, lang, 0.0) for i, t, lang in odd], docs.schema))
    got = li.predict_languages(more, model, ["doc_id", li.held_out().alias("held_out"), "lang"]).collect()
    assert len(got) == len(rows) + len(odd)
    right = [r.lang == r.lang_pred for r in got if r.held_out and r.doc_id < 1000]
    assert sum(right) / len(right) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(by_id[i] == ("und", 0.0) for i in (1000, 1001, 1002))


def test_the_sample_is_bounded_and_leaves_held_out_rows_alone(spark):
    docs = spark.createDataFrame(labelled(), "doc_id long, text string, lang string").repartition(4)
    found = Counter(lang for lang, _ in li.training_sample(docs, 7))
    assert found == {lang: 7 for lang in SYLLABLES}
    trap = docs.withColumn("lang", F.when(li.held_out(), F.lit("wrong")).otherwise(F.col("lang")))
    assert "wrong" not in [n for names in li.learned_model(trap).languages.values() for n in names]


def test_few_languages_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = li.learned_model(none)
    assert model.predict("text") == ("und", 0.0)
    assert li.predict_languages(none, model, ["doc_id"]).count() == 0
    one = li.fit([("en", li.features("the and")), ("en", li.features("and"))])
    assert one.predict("schön") == ("en", 1.0)


def test_stage_keeps_documents_and_columns(spark):
    rows = labelled() + [(900, None, "en"), (901, "77 88", "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    kept = li.language_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert len({r.doc_id for r in kept.collect()} & set(range(300))) > 290
    assert not {r.doc_id for r in kept.collect()} & {900, 901}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    judged = li.op8_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
