"""The trie against plain dictionaries of prefixes."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from claimgauge.llm import prefix_trie as pt


def plain_nodes(convs):
    """Of ``{conv_id: [(role, text), ...]}``, the contract's columns."""
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    out = []

    def below(node):
        """Leaves and savings of the subtree."""
        leaves, saved = (0, 0) if children[node] else (1, 0)
        for child in children[node]:
            more = totals[child]
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)

    totals = {}
    for node in sorted(members, key=len, reverse=True):
        totals[node] = below(node)
    for node, own in members.items():
        listed = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(children[node]), *totals[node], sha256(listed.encode()).hexdigest()))
    return out


def plain_rebuilt(rows):
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            given[c].append((turn is not None, turn or 0, pt_digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(own)] for c, own in given.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    return out


def pt_digest(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def key(row):
    return tuple(-1 if v is None else v for v in row)


SCHEMA = "conv_id long, turn long, role string, text string, place string, n int, path string"


def got(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, "p", 1, "x") for r in rows], SCHEMA).repartition(3)
    nodes = pt.prefix_trie(pt.distinct_paths(pt.paths_of(pt.rebuilt(pt.numbered_turns(table)))), **sizes)
    return sorted(
        (tuple(r) for r in nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()),
        key=key,
    )


def conversations(seed, n, hot=True):
    rng, rows = random.Random(seed), []
    for c in range(n):
        long = rng.choice([0, 1, 2, 5, 12]) if c % 7 else 3
        for t in range(long):
            text = "hello" if hot and t == 0 and c % 3 == 0 else rng.choice(["ja", "née", "no", "", None])
            rows.append((c * rng.choice([1, 1, 1]), rng.choice([t, t, None]) if c % 11 == 0 else t, ["user", "assistant", None][t % 3], text))
    return rows


def test_find_close_of_random_sequences():
    rng = random.Random(5)
    for n in (1, 2, 31, 32, 33, 64, 500, 3000):
        bits, opened = [], 0
        stack, want = [], {}
        while len(bits) < 2 * n:
            if opened < n and (not stack or rng.random() < 0.5):
                stack.append(len(bits))
                bits.append(1)
                opened += 1
            else:
                want[stack.pop()] = len(bits)
                bits.append(0)
        opens = np.flatnonzero(np.array(bits))
        assert pt.Parentheses(np.array(bits, np.int8)).find_close(opens).tolist() == [want[i] for i in opens]
    deep = np.array([1] * 5000 + [0] * 5000, np.int8)
    assert pt.Parentheses(deep).find_close(np.arange(5000)).tolist() == list(range(9999, 4999, -1))


@pytest.mark.parametrize("sizes", [{}, {"range_nodes": 10}, {"range_nodes": 40, "least_nodes": 40}, {"range_nodes": 1, "least_nodes": 1}])
def test_equals_plain_prefixes(spark, sizes):
    rows = conversations(1, 150)
    assert got(spark, rows, **sizes) == sorted(plain_nodes(plain_rebuilt(rows)), key=key)


def test_copies_ties_nulls_and_long_conversations(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 400, 5) for t in range(4)]
    rows += [(1000, t, "user", "x" * (t % 50)) for t in range(3000)]
    rows += [(2000, 1, "b", "two"), (2000, 1, "a", "one"), (2000, 1, "a", "one"), (2000, None, None, None), (None, 1, "lost", "turn"), (-7, 0, "u", "v")]
    want = plain_nodes(plain_rebuilt([(c, *r) for c, *r in rows if c != -7]))
    assert got(spark, [r for r in rows if r[0] != -7], range_nodes=500) == sorted(want, key=key)
    assert len(got(spark, rows)) > len(want) - 1


def test_only_conversations_without_turns(spark):
    # The base is absent and all own turns are replaced: a member of the root alone.
    lone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    assert got(spark, [(lone, 0, "u", "t")]) == [(lone, 0, None, 1, 0, 1, 0, sha256(str(lone).encode()).hexdigest())]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted(plain_nodes(plain_rebuilt(rows)), key=key)
    assert got(spark, rows, range_nodes=100) == want
    found = pt.op12_prefix_trie(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, found), key=key) == want
