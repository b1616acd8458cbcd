"""Near-duplicate documents by SimHash fingerprints and a binary trie self-join.

Fingerprints are 64-bit SimHashes over word 3-shingles. Two of them are linked if at most
``MAX_BITS`` bits differ. Only distinct fingerprints are joined; copies share one.

The 64 bits are read in three orders, each beginning with another third. Of two fingerprints within
two bits at least one third is equal, so in one of the orders both lie under the same trie node at the
end of the first third. From those nodes on, pairs of trie nodes are walked down together; differing
bits add up and a pair is left as soon as they exceed the budget. Nodes with few fingerprints are
walked within a task. Pairs of nodes with more are split by further bits as rows, until all are small,
so that no task ever holds a large node. Links lead to components by repeated star contraction over
stored tables.

A null text has no words, fingerprint zero, and is linked like any other. Repeated rows and equal ids
are kept, one result row each; ids may be null, which never name a component unless all ids in it are
null. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from claimgauge.llm.common import store

MAX_BITS = 2
SHINGLE_WORDS = 3
SEED = 42
#: First bits of the three reading orders: rotations by these many bits, and the bits of the first third.
ROTATIONS, THIRDS = (0, 21, 42), (21, 21, 22)
#: Most fingerprints of a trie node that is walked within one task.
NODE_SIZE = 4096
#: Bits by which a larger node pair is split at a time.
SPLIT_BITS = 6
#: Most keys of rows that are broadcast, 16 bytes each.
BROADCAST_KEYS = 500_000
#: Shingles that are counted at once, so that a very long text needs bounded memory.
CHUNK = 1 << 18

_LANES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest bit first.

    Eight bits at a time lie in the eight bytes of a word, and up to 255 words are added.
    """
    padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    padded[: len(hashes)] = hashes
    rows = padded.reshape(-1, 255)
    counts = np.zeros((8, 8), np.int64)
    for bit in range(8):
        sums = ((rows >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[:, bit] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(64)


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a UTF-8 text as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - SHINGLE_WORDS + 1
    if n < 2:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : at + CHUNK], stops[at : at + CHUNK])
        counts += _bit_counts(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64))
    return int((np.uint64(1) << np.flatnonzero(counts * 2 > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint of ``text`` as a signed long."""
    import pyarrow as pa

    source = docs.select(*keep, F.col("text").cast("binary").alias("text_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text) for text in batch.column(len(keep)).to_pylist()], np.uint64)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view(np.int64))], [*keep, "fp"])

    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("fp", T.LongType())])
    return source.mapInArrow(run, schema)


def _rotate(value: int, by: int) -> int:
    value &= (1 << 64) - 1
    return (value << by | value >> 64 - by) & (1 << 64) - 1 if by else value


def trie_pairs(left: list[int], right: list[int] | None, bits: int, budget: int) -> list[tuple[int, int]]:
    """Pairs with at most ``budget`` differing bits among the lowest ``bits``, from two sorted lists.

    Both lists are binary tries: the members of a node lie together, and its two children are the
    parts with the next bit clear and set. ``right`` None stands for pairs within ``left``.
    """
    found: list[tuple[int, int]] = []
    same = right is None
    other = left if same else right

    def middle(values: list[int], lo: int, hi: int, bit: int) -> int:
        mask = 1 << bit
        while lo < hi:
            at = (lo + hi) // 2
            if values[at] & mask:
                hi = at
            else:
                lo = at + 1
        return lo

    stack = [(0, len(left), 0, len(other), bits - 1, 0, same)]
    while stack:
        a, b, c, d, bit, differing, itself = stack.pop()
        if differing > budget or a == b or c == d or (itself and b - a < 2):
            continue
        if bit < 0 or (b - a) * (d - c) <= 36:
            mask = (1 << bit + 1) - 1
            for i in range(a, b):
                x = left[i]
                for j in range(i + 1 if itself else c, d):
                    if differing + ((x ^ other[j]) & mask).bit_count() <= budget:
                        found.append((x, other[j]))
            continue
        m = middle(left, a, b, bit)
        n = m if itself else middle(other, c, d, bit)
        stack.append((a, m, c, n, bit - 1, differing, itself))
        stack.append((m, b, n, d, bit - 1, differing, itself))
        stack.append((a, m, n, d, bit - 1, differing + 1, False))
        if not itself:
            stack.append((m, b, c, n, bit - 1, differing + 1, False))
    return found


_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _first_third_equal(a: int, b: int, rotation: int) -> bool:
    """Whether an earlier order also joins the pair, and so has found it already."""
    x = a ^ b
    return any(_rotate(x, ROTATIONS[r]) >> 64 - THIRDS[r] == 0 for r in range(rotation))


def _walk_nodes(batches):
    """Walk small nodes or node pairs; each row has the reading order and the members of both sides."""
    import pandas as pd

    for batch in batches:
        out = []
        for r, depth, differing, left, right in zip(batch.rotation, batch.depth, batch.differing, batch.side_a, batch.side_b):
            by = ROTATIONS[r]
            la = sorted(_rotate(int(x), by) for x in left)
            lb = None if right is None or not len(right) else sorted(_rotate(int(x), by) for x in right)
            for x, y in trie_pairs(la, lb, 64 - depth, MAX_BITS - differing):
                x, y = _rotate(x, 64 - by), _rotate(y, 64 - by)
                if not _first_third_equal(x, y, r):
                    out.append((_signed(x), _signed(y)))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _members(rows: DataFrame) -> DataFrame:
    """Rows of one node pair together: both sides as arrays. Only for pairs known to be small."""
    sides = rows.groupBy("rotation", "depth", "node_a", "node_b", "differing").agg(
        F.collect_list(F.when(~F.col("second"), F.col("fp"))).alias("side_a"),
        F.collect_list(F.when(F.col("second"), F.col("fp"))).alias("side_b"),
    )
    enough = (F.size("side_a") > 0) & (F.size("side_b") > 0)
    return sides.where((F.col("node_a") == F.col("node_b")) & (F.size("side_a") > 1) | enough)


def similar_fingerprints(prints: DataFrame, node_size: int = NODE_SIZE) -> DataFrame:
    """Pairs ``a, b`` of distinct ``fp`` with at most two differing bits, each pair once."""
    starts = []
    for r, (by, width) in enumerate(zip(ROTATIONS, THIRDS)):
        turned = F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", 64 - by)) if by else F.col("fp")
        starts.append(
            F.struct(F.lit(r).alias("rotation"), turned.alias("turned"), F.shiftrightunsigned(turned, 64 - width).alias("node"), F.lit(width).alias("depth"))
        )
    node = prints.select("fp", F.explode(F.array(*starts)).alias("s")).select(
        "fp", F.col("s.rotation").alias("rotation"), F.col("s.turned").alias("turned"), F.col("s.depth").alias("depth"),
        F.col("s.node").alias("node_a"), F.col("s.node").alias("node_b"), F.lit(0).alias("differing"), F.lit(False).alias("second"),
    )
    keys = ["rotation", "depth", "node_a", "node_b", "differing"]
    sizes = store(
        node.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "trie-nodes"
    )
    pairs = []
    small = sizes.where(F.col("n") <= node_size).drop("n")
    pairs.append(_members(node.join(small, keys, "left_semi")).mapInPandas(_walk_nodes, _PAIRS))
    large = sizes.where(F.col("n") > node_size)
    while not large.isEmpty():
        node = store(_split(node.join(large.drop("n"), keys, "left_semi")), "trie-split")
        sizes = store(
            node.groupBy(*keys)
            .agg(F.count_if(~F.col("second")).alias("n_a"), F.count_if(F.col("second")).alias("n_b"))
            .where("(node_a = node_b AND n_a > 1) OR (n_a > 0 AND n_b > 0)"),
            "trie-nodes",
        )
        fits = (F.col("n_a") <= node_size) & (F.col("n_b") <= node_size)
        small = sizes.where(fits).drop("n_a", "n_b")
        pairs.append(_members(node.join(small, keys, "left_semi")).mapInPandas(_walk_nodes, _PAIRS))
        large = sizes.where(~fits).select(*keys, F.lit(0).alias("n"))
    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more)
    return found


def _split(rows: DataFrame, bits: int = SPLIT_BITS) -> DataFrame:
    """Members of node pairs sent to the pairs of their descendants ``bits`` further down."""
    down = F.least(F.lit(64), F.col("depth") + bits)
    step = down - F.col("depth")
    own = F.expr("shiftrightunsigned(turned, 64 - least(64, depth + {0})) & (shiftleft(1L, least(64, depth + {0}) - depth) - 1)".format(bits))
    places = F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, least(64, depth + {bits}) - depth) - 1"))
    spread = rows.withColumns({"own": own, "step": step, "down": down}).withColumn("partner", F.explode(places))
    extra = F.bit_count(F.col("own").bitwiseXOR(F.col("partner"))).cast("int")
    spread = spread.withColumn("sum", F.col("differing") + extra).where(F.col("sum") <= MAX_BITS)
    within = F.col("node_a") == F.col("node_b")
    # A node with itself: the smaller child is the first side, so each pair of children is met once.
    first = F.when(F.col("second"), F.col("partner")).otherwise(F.col("own"))
    other = F.when(F.col("second"), F.col("own")).otherwise(F.col("partner"))
    lo, hi = F.least("own", "partner"), F.greatest("own", "partner")

    def child(node: str, tail):
        return F.expr(f"shiftleft({node}, step)").bitwiseOR(tail)

    return spread.select(
        "fp", "rotation", "turned",
        F.col("down").alias("depth"),
        child("node_a", F.when(within, lo).otherwise(first)).alias("node_a"),
        child("node_b", F.when(within, hi).otherwise(other)).alias("node_b"),
        F.col("sum").alias("differing"),
        F.when(within, F.col("own") > F.col("partner")).otherwise(F.col("second")).alias("second"),
    )


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) of all nodes of the links ``a, b``.

    Large-star and small-star contraction: every round replaces links by links to smaller nodes until
    each node is linked to the smallest of its component alone. Rounds read and write stored tables.
    """
    edges = store(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        edges = store(
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct(),
            "links",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the links did not settle")
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(prints: DataFrame) -> DataFrame:
    """``fp, component, component_id`` of every distinct fingerprint of the stored table ``doc_id, fp``.

    ``component`` is the component's smallest fingerprint, and ``component_id`` is the smallest id of all documents whose fingerprints are linked, directly or not.
    """
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    groups = store(components(similar_fingerprints(distinct)), "components")
    placed = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return placed.select("fp", "component").join(ids, "component").select("fp", "component", "component_id")


def dedup_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    prints = store(fingerprints(docs, ["doc_id"]), "fingerprints")
    return prints.join(near_duplicates(prints), "fp").select("doc_id", "fp", "component_id")


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = dedup_fingerprints(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id; of several rows with that id, one.

    Documents without an id stay if nothing in their group has one, one of each group.

    Only the keys of rows that go meet the texts again. They are broadcast up to ``BROADCAST_KEYS``, a
    counted number, and joined by shuffling beyond.
    """
    key = ["doc_id", "text_hash"]
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prints = store(fingerprints(hashed, key), "fingerprints")
    found = prints.join(near_duplicates(prints), "fp").groupBy(*key, "component", "component_id").agg(F.count("*").alias("n"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = found.where(stays).groupBy("component").agg(F.min("text_hash").alias("first_hash"))
    placed = found.join(first, "component", "left")
    chosen = F.coalesce(stays & (F.col("text_hash") == F.col("first_hash")), F.lit(False))
    judged = store(placed.select(*key, "n", chosen.alias("chosen")), "judged-rows")
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"))
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash")), how)

    kept = among(whole, judged.where("NOT chosen"), "left_anti")
    repeated = judged.where("chosen AND n > 1")
    if repeated.isEmpty():
        return kept.select("whole_row.*")
    one = among(kept, repeated, "left_semi").groupBy(*key).agg(F.min_by("whole_row", F.xxhash64("whole_row")).alias("whole_row"))
    return among(kept, repeated, "left_anti").select("whole_row.*").union(one.select("whole_row.*"))
