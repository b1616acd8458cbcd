"""The manifest against a plain tree that is hashed and folded step by step."""

import random
import zlib
from hashlib import sha256

import pytest

from claimgauge.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, tampered=False):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    doc_id, source, lang, n_chars, text = row
    if tampered and text is not None:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return h(*(field(v) for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """The root and every leaf's list of (place, run)."""
    steps, of_leaf = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, place in enumerate(of_leaf):
            steps[i].append((place % 16, runs[place // 16]))
        of_leaf = [place // 16 for place in of_leaf]
        nodes = [h(*run) for run in runs]
    return nodes[0], steps


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[source] = own, *plain_tree([plain_leaf(r) for r in own])
    root, upper = plain_tree([trees[s][1] for s in sources])
    out = []
    for i, source in enumerate(sources):
        own, subroot, steps = trees[source]
        for row, path in zip(own, steps):
            path = path + upper[i]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = plain_leaf(row, tampered)
            siblings = []
            for place, run in path:
                siblings += run[:place] + run[place + 1 :]
                folded = h(*run[:place], folded, *run[place + 1 :])
            out.append((row[0], plain_leaf(row), subroot, root, h(*siblings), folded, folded == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string, n int"


def got(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "t", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, merkle.manifest(docs).collect()), key=str)


def rows_of(n, sources, seed=1):
    rng = random.Random(seed)
    return [(i * 3, rng.choice(sources), rng.choice(["en", None]), i, rng.choice(["Some Text", "plain", "Ünï", "", None])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33, 300])
def test_small_trees(spark, n):
    rows = rows_of(n, ["b", "a", "ä", "", None]) if n > 2 else rows_of(n, ["a"])
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_several_blocks_and_rounds(spark, monkeypatch):
    # Blocks of 16^1 leaves: three rounds of blocks for the hot source.
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = rows_of(5000, ["hot"], 2) + [(i, f"s{i % 300}", "x", 1, "Some") for i in range(100_000, 100_700)]
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_blocks_of_the_usual_size(spark):
    rows = rows_of(4096 + 17, ["hot"], 3) + rows_of(20, ["a", "b"], 4)
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_nulls_repeated_rows_and_long_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "a", "en", 1, "Same")] * 20 + [(5, "a", "en", 1, "Other"), (6, "a", "", 0, "Aa " * 100_000)]
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = sorted(map(tuple, merkle.manifest(docs).collect()), key=str)
    assert found == sorted(plain(rows), key=str)
    assert {r[6] for r in found} == {True, False}
