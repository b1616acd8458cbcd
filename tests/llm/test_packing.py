"""Packing: the plan on paper, and whole results put together again."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from claimgauge.llm import packing as pk
from claimgauge.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_knapsack_equals_trying_everything():
    rng = random.Random(6)
    for _ in range(20):
        prices = {length: rng.random() for length in rng.sample(range(1, 13), 4)}
        best = [0.0] * 25
        for room in range(1, 25):
            best[room] = max([best[room - 1], *(best[room - k] + p for k, p in prices.items() if k <= room)])
        worth, pattern = pk.best_pattern(prices, 24)
        assert abs(worth - best[24]) < 1e-9
        assert abs(sum(prices[k] * n for k, n in pattern.items()) - worth) < 1e-9
        assert sum(k * n for k, n in pattern.items()) <= 24


def test_patterns_cover_all_items_with_few_sequences():
    rng = random.Random(7)
    counts = {k: rng.randrange(0, 8000 // k) for k in range(1, 64)}
    solved = pk.solve_patterns(counts)
    covered = Counter()
    for pattern, times in solved:
        for k, n in pattern.items():
            covered[k] += n * times
    assert all(abs(covered[k] - n) < 1e-5 for k, n in counts.items())
    total = sum(k * n for k, n in counts.items())
    assert sum(times for _, times in solved) <= total / 64 * 1.001 + 1


def test_rank_blocks_fill_sequences_exactly():
    rng = random.Random(8)
    counts = {k: rng.randrange(0, 200) for k in (3, 7, 16, 20, 33, 40, 61)}
    blocks, placed, sequences = pk.plan_items(counts)
    filled = defaultdict(set)
    for length, found in blocks.items():
        ranks = [r for first, end, *_ in found for r in range(first, end)]
        assert sorted(ranks) == list(range(placed[length])) and placed[length] <= counts[length]
        for first, end, sequence, each, offset in found:
            for r in range(first, end):
                which, slot = divmod(r - first, each)
                span = set(range(offset + slot * length, offset + (slot + 1) * length))
                assert not span & filled[sequence + which]
                filled[sequence + which] |= span
    assert len(filled) == sequences and all(len(f) == 64 for f in filled.values())


def test_encoder_equals_one_call():
    tokens = encoder(PATH)
    texts = ["", " ", "a\n\nb", "a  b", " a", "a ", "a\tb c", "<|endoftext|> x", "it's\nI'll don't 'sa", "a\x85b c", "x \n y"]
    texts += ["x a\nb\nc d", "a b\n", "foo***,bar !!", "x a\x1cb", "Áß ÿ x9 9x 99.", "İ中 \U0001f600 ª"]
    for text in texts + ["word, word.\nNext word " * 40]:
        assert tokens.encode(text) == tokens.direct(text)


SPECIAL = ["<|endoftext|>", "<|endoftext|> x", "a <|endoftext|> b", "in<|endoftext|>side a word", "end.<|endoftext|>, (<|endoftext|>)!", "x\n<|endoftext|>\ny z"]


def test_special_tokens_in_texts_are_their_own_ids(spark):
    tokenizer, tokens = Tokenizer.from_file(PATH), encoder(PATH)
    ids = {i: tokenizer.encode(text, add_special_tokens=False).ids for i, text in enumerate(SPECIAL)}
    assert all(50256 in found for found in ids.values())
    for i, text in enumerate(SPECIAL):
        assert np.frombuffer(tokens.encode(text), tokens.dtype).tolist() == ids[i]
    pieces = pk.pack(spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string"), PATH).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == {i: len(found) + 1 for i, found in ids.items()}


def check_pieces(pieces, texts):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(texts)
    for doc_id, found in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(9)
    texts = {i: " ".join("w%d" % rng.randrange(999) for _ in range(rng.choice([1, 5, 60, 300, 700, 2000]))) for i in range(150)}
    texts.update({500: None, 501: "", 502: "a", 503: "x " * 30000, 504: texts[3]})
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, part int, units int")
    assert check_pieces(pk.pack(docs.repartition(5), PATH).collect(), texts) == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    got = pk.pack(docs, PATH).collect()
    assert sum(p.length for p in got) == 3 + 2 + 2
    assert len({(p.sequence_id, p.offset) for p in got}) == len(got)


def test_empty_table(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
