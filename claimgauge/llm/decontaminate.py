"""Benchmark passages in training documents, found in a positional inverted index.

A phrase is a window of ``WINDOW`` consecutive words of a test item (all words of a shorter one). The
corpus frequency of every test word is counted first; a phrase with a word that never occurs is dropped
at once. The index then stores postings (word, document, position) of the two rarest words of each
remaining phrase. Their lists, adjusted by the words' offsets in the phrase, are intersected, and only
documents that pass have the postings of the phrase's other words looked up and intersected the same
way. With ``slop`` 0 matches are exact phrases; a larger slop also finds proximity matches, whose words
lie up to so many places from where the exact phrase would have them, counted from its rarest word.

All of it is built-in expressions. The words of the test set are broadcast only up to ``BROADCAST_WORDS``
distinct ones, a checked count; beyond it the same plan joins by shuffling.

A null or empty text has no words and no hits, a null or wordless item no phrase. Rows are told apart by
id and text, so repeated rows get the same answer each, and ids may be null or repeat. Other columns are
not read. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimgauge.llm.common import lower_ascii, store

WINDOW = 10
#: Most distinct test words that are broadcast, some 100 bytes each.
BROADCAST_WORDS = 500_000
#: Most row keys that are broadcast, some 60 bytes each.
BROADCAST_ROWS = 200_000
#: What lies between words, before A-Z are lower-cased.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _parts(text: Column) -> Column:
    return F.split(text, _BETWEEN)


def _word_count(text: Column) -> Column:
    """Words of the text: of its parts, the first and last may be empty."""
    n = F.size(_parts(text)) - F.when(text.rlike("^" + _BETWEEN), 1).otherwise(0)
    return F.when(text.isNull() | (text == ""), 0).otherwise(n - F.when(text.rlike(_BETWEEN + "$"), 1).otherwise(0))


def row_key() -> Column:
    """What tells rows with different texts or ids apart."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text")))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", row_key().alias("uid"), "text")


def occurrences(rows: DataFrame) -> DataFrame:
    """``uid, pos, word`` of every word; positions are counted from an arbitrary first one per row."""
    spread = rows.select("uid", F.posexplode(_parts(F.col("text"))).alias("pos", "part")).where("part <> ''")
    return spread.select("uid", "pos", lower_ascii(F.col("part")).alias("word"))


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, phrase, words`` of every distinct phrase of every item."""
    words = F.transform(F.filter(_parts(F.col("text")), lambda p: p != ""), lower_ascii)
    listed = items.select("item_id", words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    each = listed.withColumn("start", F.explode(starts)).withColumn("words", F.slice("words", F.col("start"), F.lit(window)))
    return each.select("item_id", F.array_join("words", " ").alias("phrase"), "words").distinct()


def _small(df: DataFrame, limit: int = BROADCAST_WORDS) -> DataFrame:
    """``df``, broadcast if its counted rows are within the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def _ranked(listed: DataFrame, frequency: DataFrame) -> DataFrame:
    """``phrase, n_words, terms``: (frequency, offset, word) of each word, the rarest first.

    Phrases with a word that the corpus lacks are gone.
    """
    terms = listed.select("phrase", F.size("words").alias("n_words"), F.posexplode("words").alias("offset", "word"))
    found = terms.join(frequency, "word")
    gathered = found.groupBy("phrase", "n_words").agg(
        F.sort_array(F.collect_list(F.struct("n_docs_words", "offset", "word"))).alias("terms")
    )
    return gathered.where(F.size("terms") == F.col("n_words"))


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``uid, start, n_words, phrase`` of every match; ``docs`` come from ``keyed``."""
    listed = store(phrases(items, window).select("phrase", "words").distinct(), "phrases")
    vocabulary = listed.select(F.explode("words").alias("word")).distinct()
    words = occurrences(docs)
    frequency = store(
        words.join(_small(store(vocabulary, "vocabulary")), "word").groupBy("word").agg(F.count("*").alias("n_docs_words")),
        "word-frequency",
    )
    ranked = store(_ranked(listed, frequency), "ranked-phrases")
    anchors = ranked.select(F.explode(F.slice("terms", 1, 2)["word"]).alias("word")).distinct()
    index = store(words.join(_small(store(anchors, "anchors")), "word"), "postings")

    def at(i: int, field: str) -> Column:
        return F.get(F.col("terms"), F.lit(i))[field]

    first = index.join(
        ranked.select(at(0, "word").alias("word"), at(0, "offset").alias("offset"), "phrase", "n_words", "terms"), "word"
    )
    starts = first.select("uid", (F.col("pos") - F.col("offset")).alias("start"), "phrase", "n_words", "terms")
    starts = starts.where("start >= 0")
    # The second rarest word has to lie at its place, too; a phrase of one word has none.
    second = index.select("uid", "word", "pos")
    shifts = F.sequence(F.lit(-slop), F.lit(slop))
    wanted = starts.where("n_words > 1").withColumn("shift", F.explode(shifts)).select(
        "uid", at(1, "word").alias("word"), (F.col("start") + at(1, "offset") + F.col("shift")).alias("pos"), "start", "phrase", "n_words", "terms"
    )
    both = wanted.join(second, ["uid", "word", "pos"]).select("uid", "start", "phrase", "n_words", "terms")
    possible = store(both.distinct(), "possible-matches")
    alone = starts.where("n_words = 1").select("uid", "start", "n_words", "phrase")
    pairs = possible.where("n_words = 2").select("uid", "start", "n_words", "phrase")
    longer = possible.where("n_words > 2")
    expected = (
        longer.select("uid", "start", "phrase", "n_words", F.explode(F.slice("terms", F.lit(3), F.lit(window))).alias("t"))
        .withColumn("shift", F.explode(shifts))
        .select("uid", "start", "phrase", "n_words", F.col("t.offset").alias("offset"), F.col("t.word").alias("word"),
                (F.col("start") + F.col("t.offset") + F.col("shift")).alias("pos"))
    )
    rest = occurrences(docs.join(_small(store(longer.select("uid").distinct(), "possible-rows"), BROADCAST_ROWS), "uid", "left_semi"))
    matched = (
        expected.join(rest, ["uid", "pos", "word"])
        .groupBy("uid", "start", "phrase", "n_words")
        .agg(F.count_distinct("offset").alias("n_found"))
        .where("n_found = n_words - 2")
        .select("uid", "start", "n_words", "phrase")
    )
    return matched.union(pairs).union(alone)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id, uid, n_words, n_hit, n_items, item_ids, contaminated``."""
    rows = keyed(docs)
    matches = store(phrase_matches(rows, items, window).distinct(), "matches")
    hit = (
        matches.select("uid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_words") - 1)).alias("pos"))
        .distinct()
        .groupBy("uid")
        .agg(F.count("*").alias("n_hit"))
    )
    named = (
        matches.select("uid", "phrase").distinct()
        .join(phrases(items, window).select("item_id", "phrase"), "phrase")
        .select("uid", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("uid")
        .agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item")).alias("item_ids"))
    )
    found = store(hit.join(named, "uid"), "contaminated")
    counted = rows.select("doc_id", "uid", _word_count(F.col("text")).cast("long").alias("n_words"))
    return counted.join(found, "uid", "left").select(
        "doc_id",
        "uid",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contamination(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows = keyed(docs.select("doc_id", "text"))
    bad = store(phrase_matches(rows, items).select("uid").distinct(), "contaminated-ids")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"), "doc_id", "text")
    return whole.withColumn("uid", row_key()).join(_small(bad, BROADCAST_ROWS), "uid", "left_anti").select("whole_row.*")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), lens AS (SELECT DISTINCT least(10, len(words)) AS k FROM b WHERE len(words) > 0
), items AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS k, array_to_string(words[s : s + least(10, len(words)) - 1], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM b WHERE len(words) > 0)
), p AS (
  SELECT doc_id, unnest(words) AS w, unnest(range(0, len(words))) AS i FROM d
), g AS (
  SELECT p.doc_id, p.i, lens.k, string_agg(q.w, ' ' ORDER BY q.i) AS phrase, count(*) AS c
  FROM (SELECT DISTINCT p.doc_id, p.i, items.k FROM p JOIN items ON p.w = split_part(items.phrase, ' ', 1)) s
  JOIN lens ON lens.k = s.k JOIN p ON p.doc_id = s.doc_id AND p.i = s.i
  JOIN p q ON q.doc_id = p.doc_id AND q.i BETWEEN p.i AND p.i + lens.k - 1
  GROUP BY ALL
), m AS (
  SELECT DISTINCT g.doc_id, g.i, g.k, items.item_id FROM g JOIN items ON g.phrase = items.phrase AND g.k = items.k AND g.c = g.k
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""
