"""Language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes with A-Z lower-cased and an end mark after the last one. Every byte is eight binary
decisions; a decision's contexts are the 0 to ``DEPTH`` bytes before it (marks, at the start of a text) together
with the bits already known of its own byte. Each context estimates the next bit by Krichevsky-Trofimov, and the
weighted probability of a context's training bits is

    Pw = 1/2 Pkt + 1/2 * product of Pw over the contexts that are one byte longer,    Pw = Pkt at full depth,

so that a bit's probability is a mixture over all depths, weighted by how well each one predicted in training.

How it is spread. Documents are dealt once to blocks of ``BLOCK_BYTES`` of text (a longer text is a block of its
own). A block lists its distinct grams (``DEPTH`` context bytes and the byte itself) and words with their training
counts; the counts are summed over all blocks, and the tree is built from all of them level by level, each level
an aggregation of the one below. The probabilities of the grams and the counts of the words go back to the blocks
that hold them, so no task ever needs the whole model, whatever its size. Grams that no training text holds take
part with a count of zero: a context without training bits has Pw = 1 and gives every bit one half.

A null text is an empty one, whose tokens and bytes are the end alone. A document without an id learns nothing and
counts as held out. A repeated row is scored, and learnt from, each time. Other columns are not read. An empty table
gives no rows; without any training text the word probabilities have N = V = 0 and every bit costs one bit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from claimgauge.llm.common import store

#: Bytes of the longest context.
DEPTH = 4
#: A block of documents is closed when it has reached so many bytes of text.
BLOCK_BYTES = 40 << 20
#: Bytes that are turned into grams at once.
PIECE_BYTES = 1 << 21
#: No byte of UTF-8; it ends a text and stands before its first byte.
MARK = b"\xff"
#: Added to every word count, as the contract of the base score has it.
ADDED = 0.1
HELD_OUT_FOLDS = 10

_COUNTS = "block long, gram long, word binary, n long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, text, block`` of every row, stored; ``text`` holds lower-cased bytes."""
    import pyarrow as pa

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_FOLDS == 0, F.lit(True))
    source = docs.select(
        F.col("doc_id").cast("long"), held_out.alias("held_out"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    )
    # The more text a block holds, the less its lists repeat those of others: small splits are read together.
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    source = source.coalesce(max(-(-n_bytes // block_bytes), docs.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = [text.lower() for text in batch.column(2).to_pylist()]
            of_row = []
            for text in texts:
                of_row.append(block)
                filled += len(text) + 1
                if filled >= block_bytes:
                    block, filled = block + 1, 0
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.binary()), pa.array(of_row, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "text", "block"])

    return store(source.mapInArrow(run, "doc_id long, held_out boolean, text binary, block long"), "text-blocks", "zstd")


def segments(text: bytes, depth: int = DEPTH) -> Iterator[bytes]:
    """Stretches of a text with ``depth`` bytes of context before each; together they hold every byte and the end once."""
    whole = MARK * depth + text + MARK
    for at in range(0, len(whole) - depth, PIECE_BYTES):
        yield whole[at : at + depth + PIECE_BYTES]


def grams(pieces: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """The context and the byte, as one number, of every byte behind the first ``depth`` of each piece, in order."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    first = np.zeros(len(pieces), np.int64)
    np.cumsum([len(piece) for piece in pieces[:-1]], out=first[1:])
    coded = np.ones(len(data), bool)
    for i in range(depth):
        coded[first + i] = False
    code = np.zeros(len(data) - depth, np.int64)
    for i in range(depth + 1):
        code = (code << 8) | data[i : len(data) - depth + i]
    return code[coded[depth:]]


class _GramCounts:
    """Counts of the grams of the texts added, by pieces of a bounded size."""

    def __init__(self) -> None:
        self.waiting, self.filled, self.parts = [], 0, []

    def add(self, text: bytes) -> None:
        for piece in segments(text):
            self.waiting.append(piece)
            self.filled += len(piece)
            if self.filled >= PIECE_BYTES:
                self.settle()

    def settle(self) -> None:
        if self.waiting:
            self.parts.append(np.unique(grams(self.waiting), return_counts=True))
            self.waiting, self.filled = [], 0
        if len(self.parts) > 8:
            self.parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, place = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
        return codes, np.bincount(place, np.concatenate([n for _, n in self.parts]), len(codes)).astype(np.int64)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        found, self.parts = self.merged(), []
        return found


def block_counts(blocks: DataFrame) -> DataFrame:
    """``block, gram, word, n``: what each block holds, with its count in training texts, zero if in others alone.

    One of ``gram`` and ``word`` is null. A block that two tasks read is listed by both.
    """
    import pyarrow as pa

    names = ["block", "gram", "word", "n"]

    def listed(block: int, learnt: _GramCounts, other: _GramCounts, words: Counter, unknown: set) -> Iterator[pa.RecordBatch]:
        codes, counts = learnt.take()
        more, _ = other.take()
        more = np.setdiff1d(more, codes, assume_unique=True)
        codes, counts = np.concatenate([codes, more]), np.concatenate([counts, np.zeros(len(more), np.int64)])
        blank = pa.nulls(len(codes), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block)), pa.array(codes), blank, pa.array(counts)], names)
        for word in unknown:
            words.setdefault(word, 0)
        n = len(words)
        columns = [np.full(n, block), pa.nulls(n, pa.int64()), pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *columns[1:]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, learnt, other, words, unknown = None, _GramCounts(), _GramCounts(), Counter(), set()
        for batch in batches:
            for held_out, text, block in zip(*(batch.column(i) for i in (1, 2, 3))):
                block, text = block.as_py(), text.as_py()
                if current is not None and block != current:
                    yield from listed(current, learnt, other, words, unknown)
                    words, unknown = Counter(), set()
                current = block
                if held_out.as_py():
                    other.add(text)
                    unknown.update(text.split())
                else:
                    learnt.add(text)
                    words.update(text.split())
        if current is not None:
            yield from listed(current, learnt, other, words, unknown)

    return store(blocks.mapInArrow(run, _COUNTS), "block-counts", "zstd")


def _log_gamma(x: Column) -> Column:
    """Stirling's series for x of at least 1/2, moved up by seven where x is small."""
    moved = F.when(x < 100, x + 7).otherwise(x)
    lifted = x
    for i in range(1, 7):
        lifted = lifted * (x + i)
    series = 1 / (12 * moved) - 1 / (360 * F.pow(moved, F.lit(3))) + 1 / (1260 * F.pow(moved, F.lit(5)))
    return (moved - 0.5) * F.log(moved) - moved + math.log(2 * math.pi) / 2 + series - F.when(x < 100, F.log(lifted)).otherwise(0.0)


def log_kt(zeros: Column, ones: Column) -> Column:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _levels(counted: DataFrame, depth: int) -> list[DataFrame]:
    """Per depth ``context, node, zeros, ones`` with the logarithm ``weighted`` of Pw and the own estimate's ``share``.

    ``node`` is the bits known of the byte, behind a leading one.
    """
    byte = F.col("gram").bitwiseAND(255)
    bits = [
        F.struct(
            (F.shiftright(byte, 8 - i) + (1 << i)).alias("node"),
            F.shiftright(byte, 7 - i).bitwiseAND(1).alias("bit"),
        )
        for i in range(8)
    ]
    decided = counted.select(F.shiftright("gram", 8).alias("context"), "n", F.explode(F.array(*bits)).alias("d"))
    rows = decided.groupBy("context", F.col("d.node").alias("node")).agg(
        F.sum(F.when(F.col("d.bit") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.col("d.bit") == 1, F.col("n")).otherwise(0)).alias("ones"),
    )
    own = log_kt(F.col("zeros").cast("double"), F.col("ones").cast("double"))
    levels = [store(rows.withColumn("weighted", own).withColumn("share", F.lit(1.0)), "tree-level")]
    for d in range(depth - 1, -1, -1):
        shorter = F.col("context").bitwiseAND((1 << 8 * d) - 1)
        summed = levels[-1].groupBy(shorter.alias("context"), "node").agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("longer")
        )
        mixed = summed.withColumn("own", own)
        most = F.greatest("own", "longer")
        together = most + F.log1p(F.exp(F.least("own", "longer") - most)) - math.log(2)
        share = 1 / (1 + F.exp(F.col("longer") - F.col("own")))
        levels.append(
            store(mixed.select("context", "node", "zeros", "ones", together.alias("weighted"), share.alias("share")), "tree-level")
        )
    return levels[::-1]


def gram_scores(counted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``gram, log10_p`` of every gram of the stored table ``gram, n``: the weighted probability of its byte in its context."""
    levels = _levels(counted, depth)
    n = F.col("zeros") + F.col("ones") + 1
    of_bit = [(F.col(c) + 0.5) / n for c in ("zeros", "ones")]
    state = None
    for d, level in enumerate(levels):
        # What the depths so far give a zero and a one, and the weight that is left for longer contexts.
        if state is None:
            before = level.withColumns({"p0": F.lit(0.0), "p1": F.lit(0.0), "left": F.lit(1.0)})
        else:
            above = state.withColumnsRenamed({"context": "above", "node": "above_node"})
            shorter = F.col("context").bitwiseAND((1 << 8 * (d - 1)) - 1)
            before = level.join(above, (shorter == F.col("above")) & (F.col("node") == F.col("above_node")))
        own = F.col("left") * F.col("share")
        state = before.select(
            "context", "node",
            (F.col("p0") + own * of_bit[0]).alias("p0"),
            (F.col("p1") + own * of_bit[1]).alias("p1"),
            (F.col("left") * (1 - F.col("share"))).alias("left"),
        )
        state = store(state, "tree-state") if d < depth else state
    # A context has at most 255 nodes, so its probabilities fit a map.
    entry = F.struct(F.col("node"), F.struct(F.log10("p0").alias("zero"), F.log10("p1").alias("one")))
    maps = state.groupBy("context").agg(F.map_from_entries(F.collect_list(entry)).alias("nodes"))
    total = F.lit(0.0)
    for i in range(8):
        found = F.element_at("nodes", F.shiftright(F.col("byte"), 8 - i) + (1 << i))
        total = total + F.when(F.shiftright("byte", 7 - i).bitwiseAND(1) == 0, found["zero"]).otherwise(found["one"])
    placed = counted.select("gram", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).alias("byte"))
    return placed.join(maps, "context").select("gram", total.alias("log10_p"))


def _scored(depth: int, n_all: int, n_distinct: int, n_texts: int):
    """Scores of a block's documents, given what they need of the model."""
    import pyarrow as pa

    floor = n_all + ADDED * (n_distinct + 1)

    def run(docs: pa.Table, model: pa.Table) -> pa.Table:
        code, log_p = (model.column(c).to_numpy() for c in ("gram", "log10_p"))
        is_gram = np.asarray(model.column("word").is_null())
        code, first = np.unique(code[is_gram].astype(np.int64), return_index=True)
        log_p = log_p[is_gram][first]
        known = model.filter(pa.array(~is_gram))
        words, n = known.column("word").to_pylist(), known.column("n").to_numpy()
        # Without training tokens only zero counts exist; their ratio is then 1 over V + 1 = 1.
        cost = dict(zip(words, np.log10((n + ADDED) / floor).tolist()))
        unseen = {words[i] for i in np.flatnonzero(n == 0)}
        del words, known
        end_cost = math.log10((n_texts + ADDED) / floor)
        texts = docs.column("text")
        score = np.zeros(len(texts))
        waiting, owners, filled = [], [], 0

        def settle() -> None:
            values = log_p[np.searchsorted(code, grams(waiting, depth))]
            starts = np.concatenate([[0], np.cumsum([len(p) - depth for p in waiting])[:-1]]).astype(np.int64)
            np.add.at(score, owners, np.add.reduceat(values, starts))

        n_tokens, n_known, base, n_bytes = [], [], [], []
        for i, text in enumerate(texts):
            text = text.as_py()
            n_bytes.append(len(text))
            for piece in segments(text, depth):
                waiting.append(piece)
                owners.append(i)
                filled += len(piece)
                if filled >= PIECE_BYTES:
                    settle()
                    waiting, owners, filled = [], [], 0
            words = text.split()
            n_tokens.append(len(words) + 1)
            n_known.append(len(words) - (sum(w in unseen for w in words) if unseen else 0) + (n_texts > 0))
            base.append(math.fsum(map(cost.__getitem__, words)) + end_cost)
        if waiting:
            settle()
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array(score),
                "n_bytes": pa.array(n_bytes, pa.int64()),
            }
        )

    return run


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row.

    ``bits_per_byte`` is the code length of the text and its end per byte of text, null for an empty text.
    """
    blocks = blocked(docs, block_bytes)
    counts = block_counts(blocks)
    n_texts = blocks.where("NOT held_out").count()
    by_gram = store(counts.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    by_word = store(counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_words, n_distinct = by_word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    n_all, n_distinct = n_words + n_texts, n_distinct + (n_texts > 0)
    scores = store(gram_scores(by_gram), "gram-scores")
    needed = counts.where("gram IS NOT NULL").select("block", "gram").join(scores, "gram")
    words = counts.where("word IS NOT NULL").select("block", "word").join(by_word, "word")
    model = needed.select("block", "gram", F.lit(None).cast("binary").alias("word"), "log10_p", F.lit(0).cast("long").alias("n")).union(
        words.select("block", F.lit(0).cast("long"), "word", F.lit(0.0), "n")
    )
    # A given number of partitions is not merged: a task holds few blocks, whatever the session's settings.
    n_blocks = max(1, blocks.select("block").distinct().count())
    blocks, model = (side.repartition(n_blocks, "block") for side in (blocks, model))
    scored = blocks.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(_scored(DEPTH, n_all, n_distinct, n_texts), _SCORES)
    bits = F.try_divide(F.col("score") / -math.log10(2), F.col("n_bytes"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score",
        bits.alias("bits_per_byte"),
    )


def op11_context_tree(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
