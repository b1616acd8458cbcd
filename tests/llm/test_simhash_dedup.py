"""SimHash components against brute force."""

import random

import pytest
import xxhash

from claimgauge.llm import simhash_dedup as sd


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_components(prints):
    """id -> smallest id reachable, from (id, fingerprint) pairs."""
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= 2 and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def test_fingerprint_of_short_long_and_odd_texts():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "One two", "A b C", "É É é é É", "x " * 2000, "a\x0bb\x0cc\rd"]
    texts += [" ".join(rng.choice("alpha beta gamma delta é Ü".split()) for _ in range(k)) for k in (3, 4, 256, 300, 1000)]
    for text in texts:
        assert sd.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    monkeypatch.setattr(sd, "CHUNK", 64)
    assert sd.fingerprint(text.encode()) == plain_fingerprint(text)


def test_trie_pairs_equal_all_pairs():
    rng = random.Random(2)
    base = [rng.getrandbits(16) for _ in range(12)]
    values = sorted({b ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16)) for b in base * 8})
    expected = {(x, y) for x in values for y in values if x < y and (x ^ y).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in sd.trie_pairs(values, None, 16, 2)} == expected
    half = len(values) // 2
    across = {(x, y) for x in values[:half] for y in values[half:] if (x ^ y).bit_count() <= 2}
    assert set(sd.trie_pairs(values[:half], values[half:], 16, 2)) == across


@pytest.mark.parametrize("node_size", [4096, 3])
def test_links_in_every_order_and_split(spark, node_size):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:
        for _ in range(12):
            prints.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
            prints.add(b ^ (1 << rng.randrange(20)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = [
        tuple(sorted((r.a, r.b)))
        for r in sd.similar_fingerprints(spark.createDataFrame(signed, "fp long"), node_size).collect()
    ]
    expected = {
        tuple(sorted((x, y))) for (x,) in signed for (y,) in signed if x < y and ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 2
    }
    assert len(found) == len(set(found)) and set(found) == expected


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in sd.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_documents_with_nulls_copies_and_clashing_columns(spark):
    rng = random.Random(4)
    words = ["w%d" % rng.randrange(10**6) for _ in range(400)]
    near = [*words[:200], "changed", *words[201:]]
    texts = [" ".join(words), " ".join(near), None, "", " ".join(reversed(words)), " ".join(words), "tiny", "tiny"]
    rows = [(i + 10, t, "x", 1) for i, t in enumerate(texts)] + [(10, texts[0], "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component long")
    got = sorted((r.doc_id, r.component_id) for r in sd.dedup_fingerprints(docs).collect())
    label = plain_components([(i, plain_fingerprint(t)) for i, t, *_ in rows])
    assert got == sorted((i, label[i]) for i, *_ in rows)
    kept = sd.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got})


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_rows_with_one_id_and_several_texts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sd, "BROADCAST_KEYS", broadcast)
    rng = random.Random(5)
    text = lambda: " ".join("w%d" % rng.randrange(10**6) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (7, c, "p"), (7, c, "q"), (None, text(), "n"), (9, b, "o"), (None, text(), "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, whole_row string")
    kept = sorted(r.whole_row for r in sd.dedup_stage(spark, docs, "").collect())
    assert kept in (["m", "n", "p", "x", "z"], ["m", "n", "q", "x", "z"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.dedup_fingerprints(docs).count() == 0
    assert sd.dedup_stage(spark, docs, "").count() == 0
