"""A trie of conversations: how often each prefix of turns is met, and what sharing it saves.

A conversation is the sequence of its turns (role, text) by turn number, null first; equal numbers by the turns'
digests. A null role or text is an empty one. Every distinct sequence of a conversation's first turns is a node, the
empty sequence is the root. Turns without a conversation id belong to none and are left out. Repeated rows are turns of
their own. Other columns are not read. An empty table has no conversation and gives no rows.

How it is spread. A turn becomes a digest, a prefix the digest of its parent's digest and its last turn's; a
conversation is one row of 16 bytes a turn. Distinct conversations are sorted by these paths over all tasks, so that each
task holds a contiguous range of the trie in depth-first order. It encodes its range as balanced parentheses, over
which a tree of block minima of the excess finds the close of every open parenthesis; the subtree of a node then is a
range of the encoding. Ranks count the leaves in it (the pairs "()"), cumulative sums over the nodes in order of
their opens count the members and the savings.

A node that lies neither on the first nor on the last path of a range has its whole subtree there and is done. The
others, the spines, may go on in the neighbouring ranges: what the range adds to them goes with the two paths to the
next round, which treats the paths of all ranges as a smaller trie, until one range is left. Copies of a conversation are
merged before, and a first turn shared by any number of conversations only lengthens no one's task: ranges are cut by paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, functions as F

from claimgauge.llm.common import row_identity, store

ID_BYTES = 16
#: Nodes of a range; small inputs are cut finer, for as many tasks as there are cores.
RANGE_NODES, LEAST_NODES = 200_000, 2_000
#: Positions of a block of the excess.
BLOCK = 64
#: Conversations are rebuilt from the first of so many, and take over fewer than so many turns.
GROUP, HEADS = 5, 9
NO_ENDS = sha256(b"").hexdigest()
_LARGEST = (1 << 63) - 1

_ADDED = "array<struct<depth: int, n: long, conv: long, leaves: long, saved: long, children: long, ends: string>>"
_NODES = (
    "id binary, parent_id binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    f"n_leaves long, saved_tokens long, ends_sha256 string, path binary, sizes array<long>, added {_ADDED}"
)


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with a range min-max tree of the excess over its blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        self.rank_open = np.cumsum(bits)
        n_blocks = max(1, -(-len(bits) // BLOCK))
        padded = np.full(n_blocks * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        size = 1 << (n_blocks - 1).bit_length()
        self.first_leaf = size
        self.least = np.full(2 * size, np.iinfo(np.int64).max)
        self.least[size : size + n_blocks] = padded.reshape(-1, BLOCK).min(axis=1)
        for level in range(size.bit_length() - 2, -1, -1):
            at = 1 << level
            self.least[at : 2 * at] = np.minimum(self.least[2 * at : 4 * at : 2], self.least[2 * at + 1 : 4 * at : 2])
        self.padded = padded

    def _in_block(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first position from ``start`` on, within its block, whose excess is at most ``target``; -1 if none."""
        found, waiting, at = np.full(len(start), -1), np.arange(len(start)), start.copy()
        while len(waiting):
            hit = self.padded[at] <= target[waiting]
            found[waiting[hit]] = at[hit]
            at = at + 1
            on = ~hit & (at % BLOCK != 0)
            waiting, at = waiting[on], at[on]
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The matching close of every open parenthesis: the first later position whose excess is one lower."""
        target = self.excess[opens] - 1
        close = np.full(len(opens), -1)
        own = (opens + 1) % BLOCK != 0
        close[own] = self._in_block(opens[own] + 1, target[own])
        rest = np.flatnonzero(close < 0)
        # Up to the first right neighbour that reaches the target, then down to its leftmost such block.
        node = self.first_leaf + opens[rest] // BLOCK
        climbing = np.ones(len(rest), bool)
        while climbing.any():
            right = np.where(node % 2 == 0, node + 1, node)
            hit = climbing & (node % 2 == 0) & (self.least[right] <= target[rest])
            node = np.where(hit, right, np.where(climbing, node // 2, node))
            climbing &= ~hit
        while True:
            inner = node < self.first_leaf
            if not inner.any():
                break
            left = np.where(inner, 2 * node, node)
            goes_left = self.least[np.minimum(left, len(self.least) - 1)] <= target[rest]
            node = np.where(inner, np.where(goes_left, left, left + 1), node)
        close[rest] = self._in_block((node - self.first_leaf) * BLOCK, target[rest])
        return close


class Range:
    """The trie of sorted paths, with what is added to their nodes."""

    def __init__(self) -> None:
        self.bits, self.parent, self.depth, self.ids, self.size = [1], [-1], [0], [b""], [0]
        self.n, self.conv, self.leaves, self.saved, self.children, self.ends = [0], [_LARGEST], [0], [0], [0], [None]
        self.open, self.last, self.first_spine = [0], b"", None

    def append(self, path: bytes, sizes: list[int], added: list[dict]) -> None:
        shared, most = 0, min(len(path), len(self.last)) // ID_BYTES
        while shared < most and path[shared * ID_BYTES : (shared + 1) * ID_BYTES] == self.last[shared * ID_BYTES : (shared + 1) * ID_BYTES]:
            shared += 1
        self.bits += [0] * (len(self.open) - 1 - shared)
        del self.open[shared + 1 :]
        for d in range(shared, len(path) // ID_BYTES):
            node = len(self.parent)
            self.bits.append(1)
            self.parent.append(self.open[-1])
            self.depth.append(d + 1)
            self.ids.append(path[d * ID_BYTES : (d + 1) * ID_BYTES])
            self.size.append(sizes[d])
            for values, start in ((self.n, 0), (self.conv, _LARGEST), (self.leaves, 0), (self.saved, 0), (self.children, 0), (self.ends, None)):
                values.append(start)
            self.open.append(node)
        for more in added:
            node = self.open[more["depth"]]
            self.n[node] += more["n"]
            self.conv[node] = min(self.conv[node], more["conv"])
            self.leaves[node] += more["leaves"]
            self.saved[node] += more["saved"]
            self.children[node] += more["children"]
            self.ends[node] = more["ends"] or self.ends[node]
        self.last = path
        if self.first_spine is None:
            self.first_spine = list(self.open)

    def finish(self, whole: bool) -> Iterator[dict]:
        """The nodes that are done, and unless this range is the whole trie, its two outer paths."""
        first, last = self.first_spine, list(self.open)
        self.bits += [0] * len(self.open)
        sequence = Parentheses(np.array(self.bits, np.int8))
        opens = np.flatnonzero(sequence.bits)
        until = sequence.rank_open[sequence.find_close(opens)]
        n_nodes = len(opens)
        spine = np.zeros(n_nodes, bool)
        if not whole:
            spine[first] = spine[last] = True

        def subtree(values: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(values)])
            return upto[until] - upto[:-1]

        parent = np.array(self.parent)
        own_children = np.bincount(parent[1:], minlength=n_nodes) + np.array(self.children)
        n_convs = subtree(np.array(self.n))
        # A pair "()" is a leaf unless nodes below it are already done or may come in another range.
        pair = (sequence.bits[opens + 1] == 0) & (own_children == 0) & ~spine
        n_leaves = subtree(pair + np.array(self.leaves))
        saved = subtree(np.where(spine, 0, (n_convs - 1) * np.array(self.size)) + np.array(self.saved))
        conv = list(self.conv)
        for node in range(n_nodes - 1, 0, -1):
            above = self.parent[node]
            if conv[node] < conv[above]:
                conv[above] = conv[node]
        for node in np.flatnonzero(~spine).tolist():
            above = self.parent[node]
            known = above >= 0 and not spine[above]
            yield {
                "id": self.ids[node], "parent_id": self.ids[above] if above >= 0 else None, "depth": self.depth[node],
                "conv_id": conv[node], "parent_conv_id": conv[above] if known else None, "n_convs": int(n_convs[node]),
                "n_children": int(own_children[node]), "n_leaves": int(n_leaves[node]), "saved_tokens": int(saved[node]),
                "ends_sha256": self.ends[node] or NO_ENDS,
            }
        if whole:
            return
        # What the range adds to a spine node, without what it adds to the spine nodes below it.
        beyond = {node: [int(n_convs[node]), int(n_leaves[node]), int(saved[node]), int(own_children[node])] for node in {*first, *last}}
        for node in {*first, *last}:
            above = self.parent[node]
            if above >= 0:
                for i, value in enumerate((n_convs[node], n_leaves[node], saved[node], 1)):
                    beyond[above][i] -= int(value)
        for nodes, skip in ((first, 0), (last, sum(a == b for a, b in zip(first, last)))):
            if skip == len(nodes):
                continue
            yield {
                "path": b"".join([self.ids[node] for node in nodes[1:]]), "sizes": [self.size[node] for node in nodes[1:]],
                "added": [
                    dict(depth=self.depth[node], n=beyond[node][0], conv=conv[node], leaves=beyond[node][1],
                         saved=beyond[node][2], children=beyond[node][3], ends=self.ends[node])
                    for node in nodes[skip:]
                ],
            }


def encode_ranges(paths: DataFrame, n_ranges: int) -> DataFrame:
    """One round over the stored table ``path, sizes, added``, stored: done nodes, and the spines of its ranges."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = paths.sparkSession.createDataFrame([], _NODES).schema
    arrow = to_arrow_schema(schema)
    ranged = paths.select("path", "sizes", "added")
    ranged = (ranged.repartitionByRange(n_ranges, "path") if n_ranges > 1 else ranged.coalesce(1)).sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, waiting = None, []
        for batch in batches:
            for path, sizes, added in zip(*(column.to_pylist() for column in batch.columns)):
                trie = trie or Range()
                trie.append(path, sizes, added)
        if trie is None:
            return
        for row in trie.finish(n_ranges == 1):
            waiting.append(row)
            if len(waiting) == 10_000:
                yield pa.RecordBatch.from_pylist(waiting, arrow)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, arrow)

    return store(ranged.mapInArrow(run, schema), "trie-ranges")


def prefix_trie(paths: DataFrame, range_nodes: int = RANGE_NODES, least_nodes: int = LEAST_NODES) -> DataFrame:
    """Every node of the trie of the stored table ``path, sizes, added`` of distinct paths."""
    cores = paths.sparkSession.sparkContext.defaultParallelism
    nodes = paths.agg(F.sum(F.octet_length("path") / ID_BYTES + 1)).first()[0] or 0
    n_ranges = max(1, int(-(-nodes // range_nodes)), min(2 * cores, int(-(-nodes // least_nodes))))
    rounds = [encode_ranges(paths, n_ranges)]
    while n_ranges > 1:
        spines = rounds[-1].where("path IS NOT NULL")
        nodes = spines.agg(F.sum(F.octet_length("path") / ID_BYTES + 1)).first()[0] or 0
        n_ranges = max(1, min(n_ranges // 4, int(-(-nodes // range_nodes))))
        rounds.append(encode_ranges(spines, n_ranges))
    done = [r.where("id IS NOT NULL") for r in rounds]
    if len(rounds) == 1:
        return done[0]
    later = done[1]
    for more in done[2:]:
        later = later.union(more)
    above = later.select(F.col("id").alias("above_id"), F.col("conv_id").alias("above_conv"))
    open_parent = (F.col("depth") > 0) & F.col("parent_conv_id").isNull()
    every = done[0].union(later)
    # Only nodes right below a spine lack their parent's id.
    joined = every.where(open_parent).join(above, F.col("parent_id") == F.col("above_id"))
    return every.where(~open_parent).union(joined.withColumn("parent_conv_id", F.col("above_conv")).drop("above_id", "above_conv"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place`` (from zero), ``digest`` and ``size`` of every turn, stored.

    Turns are sorted by range over all tasks, so that a conversation may hold any share of them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.substring(digest, 1, ID_BYTES).alias("digest"), F.octet_length(text).cast("long").alias("size")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    placed = row_identity(turns.repartitionByRange(*order).sortWithinPartitions(*order), "turns")
    # A conversation's turns in a task follow each other; those in earlier tasks come before them.
    in_part = placed.groupBy("conv_id", "part").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))
    starts = in_part.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "first_pos", "n"))).alias("parts"))
    earlier = F.aggregate(
        F.filter("parts", lambda p: p["part"] < F.col("part")), F.lit(0).cast("long"), lambda total, p: total + p["n"]
    )
    own = F.element_at(F.filter("parts", lambda p: p["part"] == F.col("part")), 1)["first_pos"]
    return store(placed.join(starts, "conv_id").select("conv_id", (earlier + F.col("pos") - own).alias("place"), "digest", "size"), "numbered-turns")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` of every conversation, which takes its first turns from the first one of its group.

    ``turns`` are ``place, digest, size`` in order; a conversation may be left without any.
    """
    taken = (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("taken")
    ids = turns.groupBy("conv_id").agg(F.max("place").alias("last")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), taken)
    own = turns.withColumn("taken", taken).where("place >= taken").select("conv_id", "place", "digest", "size")
    heads = turns.where((F.col("place") < HEADS - 1) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    given = ids.join(heads, "base").where("place < taken").select("conv_id", "place", "digest", "size")
    gathered = own.union(given).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "size"))).alias("turns"))
    return ids.select("conv_id").join(gathered, "conv_id", "left")


def paths_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, sizes`` of ``conv_id, turns``, stored: the digests of all prefixes, one after another."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = [], []
            for turns in batch.column(1):
                at, steps, own = b"", [], []
                for turn in turns.as_py() or []:
                    at = sha256(at + turn["digest"]).digest()[:ID_BYTES]
                    steps.append(at)
                    own.append(turn["size"])
                paths.append(b"".join(steps))
                sizes.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.binary()), pa.array(sizes, pa.list_(pa.int64()))], ["conv_id", "path", "sizes"])

    return store(conversations.mapInArrow(run, "conv_id long, path binary, sizes array<long>"), "paths")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """``path, sizes, added`` of every distinct path, stored, with its conversations' number, smallest id and hash of ids.

    The hash is one hash of a sorted list, so the ids of copies pass through one task, one by one, without being gathered.
    """
    import pyarrow as pa

    ends = paths.select(F.substring("path", -ID_BYTES, ID_BYTES).alias("id"), "conv_id")
    ordered = ends.repartition("id").sortWithinPartitions("id", "conv_id")
    names = ["first_conv", "n", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, n, digest, out = None, 0, 0, None, []
        for batch in batches:
            for end, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if end != current:
                    if current is not None:
                        out.append((first, n, digest.hexdigest()))
                    current, first, n, digest = end, conv, 1, sha256(str(conv).encode())
                else:
                    n += 1
                    digest.update(b",%d" % conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                out = []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (first, n, digest.hexdigest())], names)

    found = ordered.mapInArrow(run, "first_conv long, n long, ends string")
    zero = F.lit(0).cast("long")
    added = F.array(
        F.struct(
            F.size("sizes").alias("depth"), F.col("n"), F.col("conv_id").alias("conv"), zero.alias("leaves"), zero.alias("saved"),
            zero.alias("children"), F.col("ends"),
        )
    )
    joined = paths.join(found, F.col("conv_id") == F.col("first_conv"))
    return store(joined.select("path", "sizes", added.cast(_ADDED).alias("added")), "distinct-paths")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    nodes = prefix_trie(distinct_paths(paths_of(rebuilt(numbered_turns(conversations)))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
