"""Quality rules: base features by brute force, the cascade in any order, odd rows."""

import random
import re

from pyspark.sql import functions as F

from claimgauge.llm import quality_rules as qr


def plain_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def texts():
    rng = random.Random(17)
    words = ["the", "a", "É", "naïve", "x*", "#", "|", "<b>", "word", "\U0001f600", "A"]
    made = [
        "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", " \n", "\x0b", " "]) for _ in range(rng.randrange(0, 60)))
        for _ in range(80)
    ]
    return [*made, None, "", " \n\t", "one", "a b", "a b c", "a a a a", "x y z x y z", "\nline\nline\n\nline\n", "to " * 500]


def test_base_features_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, words string")
    got = {r.doc_id: tuple(r)[1:] for r in qr.base_features(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", *qr.BASE).collect()}
    assert got == {i: plain_features(t) for i, t in rows}


def prose(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def examples():
    return {
        "kept": prose(80),
        "symbols": " ".join(w + "***" for w in prose(80).split()),
        "capitals": prose(80).upper(),
        "wordless": " | ".join(prose(60).split()).replace("|", "12"),
        "repeated_lines": "\n".join([prose(60), *[prose(2, 1), prose(2, 2)] * 4]),
        "ellipses": "\n".join(prose(6, i) + "..." for i in range(12)),
        "bullets": "\n".join("- " + prose(6, i) for i in range(12)),
        "letters": " ".join(w[:3] + "%07d" % i for i, w in enumerate(prose(80).split())),
        "word_length": " ".join([prose(1, i) + "x" * 30 for i in range(80)]),
        "base": "short",
    }


def test_every_rule_rejects_its_kind_in_any_order(spark):
    rows = [(i, text, name) for i, (name, text) in enumerate(examples().items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    for order in (list(qr.RULES), list(reversed(qr.RULES))):
        got = {r.kind: (r.kept, r.failed_rule) for r in qr.quality_cascade(docs, order, ["kind"]).collect()}
        assert {kind for kind, (kept, _) in got.items() if kept} == {"kept"}
        assert got["symbols"][1] == "symbols" and got["base"][1] == "base"


def test_repeated_lines_between_blank_ones(spark):
    double = "\n\n".join([prose(100), *["Share this"] * 40])
    third = "\n".join([prose(20, i) for i in range(7)] + [prose(3)] * 4)
    docs = spark.createDataFrame([(1, double), (2, third), (3, third + "\n" + prose(3))], "doc_id long, text string")
    order = [r for r in qr.RULES if r.name == "repeated_lines"]
    got = {r.doc_id: (r.failed_rule, r.n_dup_lines) for r in qr.quality_cascade(docs, order, ["doc_id"]).collect()}
    assert got == {1: ("repeated_lines", 39), 2: (None, 3), 3: ("repeated_lines", 4)}


def test_dearer_rules_of_equal_selectivity_come_later(spark):
    docs = spark.createDataFrame([(i, prose(80, i)) for i in range(200)], "doc_id long, text string")
    cheap = qr.Rule("z_cheap", lambda: qr._count_of(F.col("text"), "[^a]+") < 20)
    copies = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: qr._count_of(F.concat("text", i.cast("string")), "[^a]+"))
    dear = qr.Rule("a_dear", lambda: F.array_max(copies) < 20)
    for _ in range(3):
        assert [r.name for r in qr.measured_order(docs, (dear, cheap))] == ["z_cheap", "a_dear"]


def test_order_puts_rejecting_rules_first(spark):
    rows = [(i, t) for i, t in enumerate([examples()["symbols"]] * 30 + [prose(80, i) for i in range(10)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = qr.measured_order(docs, sample_rows=25)
    assert {r.name for r in order} == {r.name for r in qr.RULES}
    assert order[0].name in ("symbols", "letters", "wordless", "word_length")
    assert len(qr.measured_order(docs.limit(0))) == len(qr.RULES)


def test_stage_and_odd_rows(spark):
    rows = [(1, prose(80), "a"), (1, prose(80), "a"), (2, None, "b"), (3, "", "c"), (None, prose(90), "d"), (4, prose(60) + " " + "z" * 100_000, "e"),
            (5, "to " * 200_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, whole_row string")
    kept = qr.quality_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.whole_row for r in kept.collect()) == ["a", "a", "d"]
    assert qr.quality_stage(spark, docs.limit(0), "").count() == 0


def test_no_python_on_executors(spark):
    docs = spark.createDataFrame([(1, prose(60))], "doc_id long, text string")
    plan = qr.quality_cascade(docs, list(qr.RULES), ["doc_id"]).where(F.col("kept"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
