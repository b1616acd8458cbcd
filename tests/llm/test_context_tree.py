"""Context-tree weighting against a plain tree of all contexts, and the unigram base."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from claimgauge.llm import context_tree as ct

DEPTH = ct.DEPTH


def plain_kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


class PlainTree:
    """Counts of every (context, known bits), and the mixture by the recursive definition."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        self.memo = {}
        for text in texts:
            for context, byte in self.places(text):
                for i in range(8):
                    node = (1 << i) | (byte >> (8 - i))
                    for d in range(DEPTH + 1):
                        key = (context[DEPTH - d :], node)
                        self.counts[key][(byte >> (7 - i)) & 1] += 1
                        if d < DEPTH:
                            self.children[key].add((context[DEPTH - d - 1 :], node))

    @staticmethod
    def places(text):
        whole = b"\xff" * DEPTH + text + b"\xff"
        return [(whole[i - DEPTH : i], whole[i]) for i in range(DEPTH, len(whole))]

    def weighted(self, key):
        if key not in self.memo:
            own = plain_kt(*self.counts[key])
            if len(key[0]) == DEPTH:
                self.memo[key] = own, 1.0
            else:
                longer = sum(self.weighted(c)[0] for c in self.children[key])
                most = max(own, longer)
                mixed = most + math.log(0.5 * math.exp(own - most) + 0.5 * math.exp(longer - most))
                self.memo[key] = mixed, math.exp(own - math.log(2) - mixed)
        return self.memo[key]

    def bit(self, context, node, bit, d=0):
        key = (context[DEPTH - d :], node)
        if key not in self.counts:
            return 0.5
        own = (self.counts[key][bit] + 0.5) / (sum(self.counts[key]) + 1)
        if d == DEPTH:
            return own
        share = self.weighted(key)[1]
        return share * own + (1 - share) * self.bit(context, node, bit, d + 1)

    def score(self, text):
        return sum(
            math.log10(self.bit(context, (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1))
            for context, byte in self.places(text)
            for i in range(8)
        )


def plain(rows):
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = [(t or "").encode().lower() for _, t in rows]
    tree = PlainTree([t for t, h in zip(texts, held) if not h])
    counts = Counter()
    for t, h in zip(texts, held):
        if not h:
            counts.update([*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, _), t, h in zip(rows, texts, held):
        tokens = [*t.split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, h, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, tree.score(t)))
    return out


def close(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r[5], r[6])
    got, want = sorted([tuple(r)[:7] for r in got], key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-8, abs=1e-8)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "über", "naïve", "<|x|>", "a", "zzz", "cat's", "日本"]
    return [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30])))) for i in range(n)]


@pytest.mark.parametrize("block_bytes", [1, 300, ct.BLOCK_BYTES])
def test_equals_plain_tree(spark, block_bytes):
    rows = texts(3, 60) + [(None, "no id at all"), (70, None), (71, ""), (5, "again"), (5, "again"), (72, "\x0b new line \t")]
    docs = spark.createDataFrame([(i, t, 0, "g", 1.0) for i, t in rows], "doc_id long, text string, block int, gram string, n double")
    close(ct.score_texts(docs.repartition(3), block_bytes).collect(), plain(rows))


def test_pieces_and_long_texts(spark, monkeypatch):
    rows = texts(4, 20) + [(100, "lorem ipsum dolor " * 400), (101, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = ct.score_texts(docs).collect()
    close(whole, plain(rows))
    monkeypatch.setattr(ct, "PIECE_BYTES", 64)
    assert sorted(b"".join(p[DEPTH:] for p in ct.segments(b"abc" * 100))) == sorted(b"abc" * 100 + ct.MARK)
    whole_text = b"some words " * 50
    assert list(ct.grams(list(ct.segments(whole_text)))) == [
        int.from_bytes(c + bytes([b]), "big") for c, b in PlainTree.places(whole_text)
    ]


def test_empty_table_and_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ct.score_texts(empty).collect() == []
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = ct.score_texts(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).first()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0
    assert row.base_score == pytest.approx(0) and row.score == pytest.approx(5 * 8 * math.log10(0.5))


def test_code_length_of_unseen_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = ct.score_texts(docs).where("held_out AND n_tokens > 50").collect()
    assert rows and all(r.score < 0 for r in rows)
    assert sum(r.bits_per_byte for r in rows) / len(rows) < 3
