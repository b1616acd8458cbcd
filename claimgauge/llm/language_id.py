"""Language identification in two steps: the family first, then linear machines one against one within it.

Features are hashed character 1- to 3-grams of the whole lower-cased text with everything but letters as a space,
as shares with square roots taken. The family is predicted by linear machines one against the rest;
within the family, every pair of languages has a linear support vector machine of its own, and the
language with most votes wins, ties by the sum of margins. All are trained by averaged stochastic
gradient descent on the hinge loss, in a fixed order.

Training uses at most ``PER_LANGUAGE`` documents of each language, those with the smallest id hashes among
the training rows; predictions read the text alone, and all of it. Texts that are null or without a
letter are ``und`` with score 0. Languages without training rows are never predicted; with a single one
that one is. Repeated rows get the same answer, ids may be null, other columns are not read, an
empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from claimgauge.llm.common import store

#: Bound of the training sample.
PER_LANGUAGE = 400
#: Ids are counted by so many first bits of their hashes to find the sample.
TOP_BITS = 14
DIMENSIONS = 1 << 12
EPOCHS = 4
RATE, DECAY = 0.5, 1e-5
SEED = 8
UNKNOWN = "und"
#: Code points of a text that are looked at together; neighbours overlap by two.
CHUNK = 1 << 20
#: Languages are rejected below this score.
MIN_SCORE = 0.5

# Language families. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_STEP = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language, language)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of the hashed n-grams, of length 1 together; None without a letter."""
    plain = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not plain:
        return None
    counts = np.zeros(DIMENSIONS)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(codes) - 1, CHUNK):
        c = codes[at : at + CHUNK + 2]
        one = c * _STEP[0]
        two = one[:-1] + c[1:] * _STEP[1]
        three = two[:-1] + c[2:] * _STEP[2]
        # Where a chunk goes on in the next one, its last two letters are counted there.
        own = min(CHUNK, len(c))
        for grams in (one[:own], two[:own], three[:own]):
            counts += np.bincount((grams * np.uint32(2654435769)) >> shift, minlength=DIMENSIONS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


@dataclasses.dataclass(frozen=True)
class LanguageModel:
    """Weights of the family machines, and of the pairs of languages of each family."""

    families: tuple[str, ...]
    languages: dict[str, tuple[str, ...]]
    family_weights: np.ndarray
    pairs: dict[str, tuple[tuple[int, int], ...]]
    pair_weights: dict[str, np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or not self.families:
            return UNKNOWN, 0.0
        x = np.append(x, np.float32(1))
        margins = self.family_weights @ x
        best = int(np.argmax(margins))
        family = self.families[best]
        score = _lead_score(margins, best)
        names = self.languages[family]
        if len(names) == 1:
            return names[0], score
        votes, sums = np.zeros(len(names)), np.zeros(len(names))
        won = self.pair_weights[family] @ x
        for (a, b), margin in zip(self.pairs[family], won):
            votes[a if margin >= 0 else b] += 1
            sums[a] += margin
            sums[b] -= margin
        chosen = int(np.lexsort((-np.arange(len(names)), sums, votes))[-1])
        against = [margin if a == chosen else -margin for (a, b), margin in zip(self.pairs[family], won) if chosen in (a, b)]
        return names[chosen], score * float(1 / (1 + np.exp(-4 * min(against))))


def _lead_score(margins: np.ndarray, best: int) -> float:
    """A score of the winning family from its lead over the next one; 1 if it is alone."""
    if len(margins) == 1:
        return 1.0
    lead = margins[best] - np.max(np.delete(margins, best))
    return float(1 / (1 + np.exp(-4 * lead)))


def train_machine(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """A linear support vector machine: averaged gradient steps on the hinge loss, both classes weighed alike."""
    rng = np.random.default_rng(SEED)
    y = np.where(positive, 1.0, -1.0)
    share = positive.mean()
    weight = np.where(positive, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    w, mean, n = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    scale = 8.0
    for _ in range(EPOCHS):
        for i in np.array_split(rng.permutation(len(y)), max(1, len(y) // 16)):
            n += 1
            wrong = i[y[i] * (x[i] @ w) * scale < 1]
            w *= 1 - RATE * DECAY
            if len(wrong):
                w += RATE / np.sqrt(n) * scale * ((y[wrong] * weight[wrong]) @ x[wrong]) / len(i)
            mean += (w - mean) / n
    return (mean * scale).astype(np.float32)


def fit(samples: list[tuple[str, np.ndarray]]) -> LanguageModel:
    """The model from ``(language, features)``, in the order given."""
    names = sorted({language for language, _ in samples})
    families = tuple(sorted({family_of(n) for n in names}))
    languages = {f: tuple(n for n in names if family_of(n) == f) for f in families}
    label = np.array([language for language, _ in samples])
    x = np.ones((len(samples), DIMENSIONS + 1), np.float32)
    for i, (_, v) in enumerate(samples):
        x[i, :-1] = v
    of_family = np.array([family_of(language) for language in label])
    if len(families) == 1:
        family_weights = np.zeros((1, DIMENSIONS + 1), np.float32)
    else:
        family_weights = np.array([train_machine(x, of_family == f) for f in families])
    pairs, pair_weights = {}, {}
    for f in families:
        pairs[f] = tuple(combinations(range(len(languages[f])), 2))
        rows = []
        for a, b in pairs[f]:
            two = (label == languages[f][a]) | (label == languages[f][b])
            rows.append(train_machine(x[two], label[two] == languages[f][a]))
        pair_weights[f] = np.array(rows)
    return LanguageModel(families, languages, family_weights, pairs, pair_weights)


def training_sample(rows: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, np.ndarray]]:
    """At most so many ``(lang, features)`` per language of ``doc_id, text, lang``, by the hash of the id.

    Which ones is found on ids alone: hashes are counted by their first bits, and only those up to
    the place where the counts reach the bound are ranked.
    """
    import pyarrow as pa

    narrow = rows.where("lang IS NOT NULL").select("lang", F.xxhash64("doc_id").alias("h"))
    before = Window.partitionBy("lang").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    counted = narrow.groupBy("lang", F.shiftright("h", 64 - TOP_BITS).alias("top")).agg(F.count("*").alias("n"))
    needed = counted.where(F.col("n") > 0).withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    reach = needed.where(F.col("n_before") < per_language).groupBy("lang").agg(F.max("top").alias("reach"))
    # A row per language; joining on the language would bring all its rows into one task.
    reached = F.lit(False)
    for row in reach.collect():
        reached = reached | ((F.col("lang") == row["lang"]) & (F.shiftright("h", 64 - TOP_BITS) <= row["reach"]))
    near = narrow.where(reached)
    best = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= per_language)
    last = {r["lang"]: r["h"] for r in best.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not last:
        return []
    within = F.lit(False)
    for language, h in last.items():
        within = within | ((F.col("lang") == language) & (F.xxhash64("doc_id") <= h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, language, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                x = features(text)
                if x is not None:
                    out.append((h, language, x.astype("<f2").tobytes()))
            if out:
                h, languages, data = zip(*out)
                columns = [pa.array(h, pa.int64()), pa.array(languages, pa.string()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "lang", "x"])

    sample = store(rows.where(within).select(F.xxhash64("doc_id").alias("h"), "lang", "text").mapInArrow(run, "h long, lang string, x binary"), "language-sample")
    ranked = sample.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "x"))).where(F.col("k") <= per_language)
    found = ranked.orderBy("h", "lang", "x").collect()
    return [(r["lang"], np.frombuffer(r["x"], "<f2")) for r in found]


def predict_languages(docs: DataFrame, model: LanguageModel, keep: list[str | Column]) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` from the whole text."""
    import pyarrow as pa

    source = docs.select(*keep, F.col("text").alias("text_to_judge"))
    n = len(source.columns) - 1
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*source.schema.fields[:n], *added])
    shared = source.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(text.as_py()) for text in batch.column(n)]
            names, scores = zip(*found) if found else ((), ())
            columns = [batch.column(i) for i in range(n)] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learned_model(docs: DataFrame) -> LanguageModel:
    """The model of all rows that are not held out; a row without an id is never trained on."""
    trained = docs.where("doc_id IS NOT NULL").where(~held_out()).select("doc_id", "text", "lang")
    return fit(training_sample(trained))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learned_model(docs)
    return predict_languages(docs, model, ["doc_id", held_out().alias("held_out")])


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognized with at least ``MIN_SCORE``."""
    model = learned_model(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"), "text")
    judged = predict_languages(rows, model, ["whole_row"])
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("whole_row.*")
