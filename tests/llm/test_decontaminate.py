"""Benchmark passages against brute force."""

import random
import re

import pytest

from claimgauge.llm import decontaminate as dc


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item_id, item in items:
            w = plain_words(item)
            k = min(window, len(w))
            for s in range(len(w) - k + 1 if k else 0):
                for i in range(len(words) - k + 1):
                    if words[i : i + k] == w[s : s + k]:
                        hit.update(range(i, i + k))
                        found.add(str(item_id))
        out.append((doc_id, len(words), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def tables(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "É", "é", "x1", "Zebra", "naïve"] + ["w%d" % i for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 9, 10, 11, 25, 40, 30, 12])]
    items += [(10, None), (11, " .,"), (12, items[6][1]), (None, "quite alone here"), (14, "the the the the the the the the the the the")]
    docs = []
    for i in range(60):
        at, pieces = rng.randrange(9), plain_words(rng.choice(items[:10])[1])
        body = text(rng.randrange(0, 40))
        docs.append((i, body + ",\n" + " - ".join(pieces[at:]).upper() + "! " + text(5)))
    docs += [(100, None), (101, ""), (102, "..."), (103, "the " * 30), (104, "." + items[5][1] + "."), (104, "." + items[5][1] + "."), (None, items[6][1]), (7, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("broadcast", [True, False])
def test_hits_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(dc, "_small", lambda df, limit=0: df)
    docs, items = tables(spark)
    frame = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, pos int, word string")
    listed = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, start int")
    got = dc.contamination(frame.select("doc_id", "text"), listed).collect()
    named = [(i, t) for i, t in items if i is not None]
    expected = plain(docs, named)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got], key=repr) == expected


def test_proximity_finds_passages_with_an_inserted_word(spark):
    passage = "one two three four five six seven eight nine ten".split()
    loose = " ".join([*passage[:5], "inserted", *passage[5:]])
    docs = spark.createDataFrame([(1, " ".join(passage)), (2, loose), (3, " ".join(reversed(passage)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    ids = lambda slop: sorted({r.uid.split(":")[0] for r in dc.phrase_matches(dc.keyed(docs), items, slop=slop).collect()})
    assert ids(0) == ["1"] and ids(1) == ["1", "2"]


def test_stage_keeps_clean_rows_and_columns(spark, tmp_path):
    passage = " ".join("b%d" % i for i in range(12))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(
        [(1, "before " + passage, "a"), (2, "clean words only", "b"), (2, "clean words only", "b"), (3, None, "c"), (None, passage[3:], "d")],
        "doc_id long, text string, uid string",
    )
    kept = dc.decontamination_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.uid for r in kept.collect()) == ["b", "b", "c"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert dc.contamination(none, items).count() == 0
    assert [tuple(r) for r in dc.contamination(one, items).select("n_words", "n_hit", "contaminated").collect()] == [(2, 0, False)]


def test_no_python_on_executors(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = dc.contamination(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
