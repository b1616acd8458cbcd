"""Quality rules as a short-circuit cascade of built-in expressions.

Every document gets the base features. The rules of the cascade run only on documents that pass the
base check, and a document is out at its first rule that fails. Rules are ordered by rejections per
second, both measured on a sample, so that cheap rules that reject much come first. The order never
changes which documents are kept, only the work that it takes.

Null and empty texts have no words and fail the base check. Rows are judged one by one: repeated rows
get the same answer, other columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import statistics
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from claimgauge.llm.common import SPACES, store, words_of

#: Rows of the sample that costs and rejections are measured on: those whose ids have the smallest hashes.
SAMPLE_ROWS = 1000
#: What a measurement of a rule takes at least, how often the sample is gone through at most, and the runs it is the median of.
MEASURED_SECONDS, MEASURED_TIMES, MEASURED_RUNS = 0.2, 1024, 3
#: Base check: fewest words, and most percent of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclasses.dataclass(frozen=True)
class Rule:
    """``fails`` is an expression over the text, its words and the base features."""

    name: str
    fails: Callable[[], Column]


def _count_of(text: Column, pattern: str) -> Column:
    """Characters of the text that are in a class, given the complement of the class."""
    return F.char_length(F.regexp_replace(text, pattern, ""))


def _word_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def _share_of_lines(pattern: str) -> Column:
    hits = F.filter(F.split("text", "\n"), lambda line: line.rlike(pattern))
    return F.size(hits) / F.greatest(F.size(_word_lines(F.col("text"))), F.lit(1))


#: Thresholds follow common rule sets for web text; prose of any language stays far from them.
RULES = (
    Rule("symbols", lambda: F.col("n_symbols") * 10 > F.col("n_words")),
    Rule("word_length", lambda: ~(F.col("word_chars") / F.col("n_words")).between(2, 15)),
    Rule("repeated_lines", lambda: F.col("n_dup_lines") * 10 > 3 * F.size(_word_lines(F.col("text")))),
    Rule("capitals", lambda: _count_of(F.col("text"), "[^\\p{Lu}]+") * 10 > 4 * F.col("word_chars")),
    Rule("letters", lambda: _count_of(F.col("text"), "\\P{L}+") * 2 < F.col("word_chars")),
    Rule("wordless", lambda: F.size(F.filter("words", lambda w: w.rlike("\\p{L}"))) * 10 < 7 * F.col("n_words")),
    Rule("bullets", lambda: _share_of_lines("^[\\x20\\x09]*[-*•]") > 0.9),
    Rule("ellipses", lambda: _share_of_lines("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$") > 0.3),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered_words(s: Column) -> Column:
    """Words covered by windows that occur twice or more; windows are sorted with their places."""
    last = F.size(s) - 1
    twice = F.filter(
        s,
        lambda w, i: ((i > 0) & (w["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"]))
        | ((i < last) & (w["h"] == F.get(s, F.least(i + 1, last))["h"])),
    )
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))


def _repeated_words(words: Column) -> Column:
    """Words in repeated 3-word windows. Windows are compared by 64-bit hashes, and sorted only if some repeat."""

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(placed, _covered_words)).otherwise(0)

    return _let(words, lambda w: F.when(F.size(w) >= 3, _let(windows(w), count)).otherwise(0))


def _repeated_lines(text: Column) -> Column:
    return _let(_word_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``text`` (null as empty), ``words`` and the base features of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*keep, text.alias("text"), words_of(F.col("text")).alias("words")).select(
        *keep,
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), "[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        _repeated_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measured_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a bounded sample, best first.

    A rule is applied to the stored features of the sample so many times over, in one job, that the job takes
    ``MEASURED_SECONDS`` or more beyond the same job without a rule. The cost is the median of ``MEASURED_RUNS`` such
    jobs. Only numbers come back.
    """
    hashes = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample_rows).collect()
    last = hashes[-1]["h"] if hashes else 0
    sample = docs.select("doc_id", "text").where(F.xxhash64("doc_id") <= last).limit(sample_rows)
    features = store(base_features(sample, ["doc_id"]).where(~base_failed()), "rule-sample")
    if features.isEmpty():
        return list(rules)

    def run(fails: Column, times: int) -> tuple[float, int]:
        repeated = features.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(times))))
        began = time.perf_counter()
        rejected = repeated.agg(F.count_if(fails)).first()[0]
        return time.perf_counter() - began, rejected // times

    idle: dict[int, float] = {}

    def cost(fails: Column, times: int) -> float:
        if times not in idle:
            idle[times] = statistics.median(run(F.length("text") < 0, times)[0] for _ in range(MEASURED_RUNS))
        return run(fails, times)[0] - idle[times]

    scores = []
    for rule in rules:
        times = 1
        _, rejected = run(rule.fails(), times)
        while cost(rule.fails(), times) < MEASURED_SECONDS and times < MEASURED_TIMES:
            times *= 4
        seconds = statistics.median(cost(rule.fails(), times) for _ in range(MEASURED_RUNS)) / times
        scores.append((-(rejected + 1e-3) / max(seconds, 1e-7), rule.name, rule))
    return [rule for _, _, rule in sorted(scores, key=lambda s: s[:2])]


def quality_cascade(docs: DataFrame, order: list[Rule], keep: list[str]) -> DataFrame:
    """``keep`` columns, base features, ``base_failed``, ``failed_rule`` (the first in order) and ``kept``."""
    first = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        first = first.when(rule.fails(), F.lit(rule.name))
    judged = base_features(docs, keep).withColumn("base_failed", base_failed()).withColumn("failed_rule", first)
    return judged.select(*keep, *BASE, "base_failed", "failed_rule", F.col("failed_rule").isNull().alias("kept"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = quality_cascade(docs, measured_order(docs), ["doc_id"])
    return judged.select("doc_id", *BASE, "base_failed", "kept")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and every rule."""
    order = measured_order(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"), "text")
    return quality_cascade(rows, order, ["whole_row"]).where("kept").select("whole_row.*")


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), w AS (
  SELECT *, len(words) AS n,
         list_filter(string_split(text, E'\n'), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), p AS (
  SELECT doc_id, unnest(words) AS a, unnest(range(0, n)) AS i FROM w
), g AS (
  SELECT doc_id, i, a || ' ' || lead(a) OVER d || ' ' || lead(a, 2) OVER d AS win
  FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g WHERE win IS NOT NULL
    ) WHERE c > 1
  ) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, text, words, CAST(n AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_word_lines, string_split(text, E'\n') AS all_lines
  FROM w LEFT JOIN h ON w.doc_id = h.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE
         n_symbols * 10 <= n_words
         AND word_chars / n_words BETWEEN 2 AND 15
         AND n_dup_lines * 10 <= 3 * n_word_lines
         AND length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) * 10 <= 4 * word_chars
         AND length(regexp_replace(text, '\P{L}+', '', 'g')) * 2 >= word_chars
         AND len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) * 10 >= 7 * n_words
         AND len(list_filter(all_lines, lambda l: regexp_matches(l, '^[\x20\x09]*[-*•]'))) / greatest(n_word_lines, 1) <= 0.9
         AND len(list_filter(all_lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) / greatest(n_word_lines, 1) <= 0.3
       END AS kept
FROM b
"""
