"""A Merkle manifest of documents: every document with a proof that folds to the dataset's root.

H is the lowercase hex SHA-256 of its inputs one after another, digests as hex text. A row's leaf is H of its
fields; leaves of a source ascend by id (null ids first, equal ids by leaf, so that repeated rows need no order),
and every 16 consecutive nodes become their H until one is left, the subroot. The subroots, by source (null first),
become the root in the same way. A proof holds the other nodes of each run from the leaf up to the root.

Nodes are appended to a tree one by one. The tree keeps the open run of every level, and each open run keeps the
witnesses of all that lies below it; when a run is complete, its members' digests extend those witnesses and the
run's own digest is appended one level up. Numbered leaves are cut into aligned blocks of 16^3, every block is
appended in a task of its own, and the blocks' roots are the next tree's leaves: what that tree adds to the witness
of a block's root completes the witnesses of all its leaves. The same goes on until one root is left per source, and
over the sources. A witness is stored once per run of 16 leaves.

A null field counts as ``-``, a null id is not tampered with, and empty and null texts differ. Other columns are
not read. A single leaf is its source's subroot, a single subroot is the root. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimgauge.llm.common import LOWER, UPPER, row_identity, store

ARITY = 16
#: Levels of a block's tree, and the leaves it takes.
BLOCK_LEVELS = 3
BLOCK = ARITY**BLOCK_LEVELS
DIGEST_CHARS = 64
#: Every so many-th document, by the checksum of its id, is tampered with.
TAMPERED_FOLD = 5

_MEMBERS = "array<struct<key: long, digest: string, altered: string>>"
_WITNESS = "array<struct<place: int, run: string>>"
_RUNS = f"tree string, block long, first boolean, n long, closed boolean, members {_MEMBERS}, witness {_WITNESS}, root string"


def joined_digest(run: str) -> str:
    return sha256(run.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class OpenTree:
    """Appends to a tree of a known height.

    ``open[level]`` holds the nodes of the open run: digest, and the witnesses that wait for the run to close.
    """

    def __init__(self, levels: int):
        self.levels, self.open, self.runs, self.leaves = levels, [[] for _ in range(levels + 1)], [], []

    def append(self, leaf: dict) -> None:
        self.leaves.append(leaf)
        if len(self.leaves) == ARITY and self.levels:
            self._close_leaves()

    def _close_leaves(self) -> None:
        witness: list[dict] = []
        self.runs.append((self.leaves, witness))
        digest = joined_digest("".join([leaf["digest"] for leaf in self.leaves]))
        self.leaves = []
        self._add(1, digest, [witness])

    def _add(self, level: int, digest: str, witnesses: list[list]) -> None:
        nodes = self.open[level]
        nodes.append((digest, witnesses))
        if len(nodes) == ARITY and level < self.levels:
            self._close(level)

    def _close(self, level: int) -> None:
        nodes, self.open[level] = self.open[level], []
        run = "".join([digest for digest, _ in nodes])
        for place, (_, witnesses) in enumerate(nodes):
            step = {"place": place, "run": run}
            for witness in witnesses:
                witness.append(step)
        self._add(level + 1, joined_digest(run), [w for _, witnesses in nodes for w in witnesses])

    def finish(self) -> str:
        """Close what is open, and return the root."""
        if not self.levels:
            self.runs.append((self.leaves, []))
            return self.leaves[0]["digest"]
        if self.leaves:
            self._close_leaves()
        for level in range(1, self.levels):
            if self.open[level]:
                self._close(level)
        return self.open[self.levels][0][0]


def numbered(rows: DataFrame, tree: Column, order: list[str]) -> DataFrame:
    """The rows with ``tree``, their place ``pos`` in it from zero, and its number ``n`` of rows, in the order given.

    Rows are sorted by range over all tasks; a row's number is its place in its task after all rows of the
    tasks before, so that a tree may hold any share of the rows.
    """
    keyed = rows.withColumn("tree", tree)
    order = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    placed = row_identity(keyed.repartitionByRange(*order).sortWithinPartitions(*order), "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the sort.
    parts = placed.groupBy("part").agg(F.count("*").alias("rows")).select(
        F.col("part").alias("of_part"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")
    )
    number = F.col("rows_before") + F.col("pos") - F.shiftleft(F.col("part").cast("long"), 33)
    placed = placed.join(parts, F.col("part") == F.col("of_part")).withColumn("pos", number).drop("part", "of_part", "rows_before")
    trees = placed.groupBy("tree").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))
    return placed.join(trees, "tree").withColumn("pos", F.col("pos") - F.col("first_pos")).drop("first_pos")


def _append_blocks(nodes: DataFrame) -> DataFrame:
    """One row per run of the nodes ``tree, pos, key, digest, altered, n``, stored: members, witness up to the block's root, root."""
    import pyarrow as pa

    dealt = nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "key", "digest", "altered")
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    schema = dealt.sparkSession.createDataFrame([], _RUNS).schema

    def finished(tree: str, block: int, n: int, appended: OpenTree) -> Iterator[pa.RecordBatch]:
        root = appended.finish()
        rows = [
            (tree, block, i == 0, n, appended.levels > 0, members, witness, root)
            for i, (members, witness) in enumerate(appended.runs)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], arrow.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, appended = None, None
        for batch in batches:
            tree, block, _, n, key, digest, altered = (column.to_pylist() for column in batch.columns)
            for i in range(batch.num_rows):
                if (tree[i], block[i]) != (current and current[:2]):
                    if current is not None:
                        yield from finished(*current, appended)
                    current, appended = (tree[i], block[i], n[i]), OpenTree(min(height(n[i]), BLOCK_LEVELS))
                appended.append({"key": key[i], "digest": digest[i], "altered": altered[i]})
        if current is not None:
            yield from finished(*current, appended)

    return store(dealt.mapInArrow(run, schema), "merkle-runs")


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of the trees' leaves with the witness ``above`` their blocks' roots, and ``tree, root`` of every tree."""
    runs = _append_blocks(nodes)
    roots = runs.where("first").select(
        "tree", F.col("block").alias("pos"), F.col("block").alias("key"), F.col("root").alias("digest"),
        F.lit(None).cast("string").alias("altered"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
    )
    if (roots.agg(F.max("n")).first()[0] or 0) <= 1:
        return runs.withColumn("above", F.array().cast(_WITNESS)), roots.select("tree", F.col("digest").alias("root"))
    higher, tops = climb(roots)
    return runs.join(_witness_of_members(higher).withColumnRenamed("key", "block"), ["tree", "block"]), tops


def _witness_of_members(runs: DataFrame) -> DataFrame:
    """``tree, key, above``: the whole witness of every member of the runs."""
    whole = F.concat_ws("", F.col("members.digest"))
    own = F.when(F.col("closed"), F.array(F.struct(F.col("place").cast("int").alias("place"), F.col("run")))).otherwise(F.array().cast(_WITNESS))
    return (
        runs.select("tree", "closed", "witness", "above", whole.alias("run"), F.posexplode("members").alias("place", "member"))
        .select("tree", F.col("member.key").alias("key"), F.concat(own, "witness", "above").alias("above"))
    )


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``key, source, digest`` of every row, and the digest ``altered`` of its tampered form where that differs."""

    def leaf(text: Column) -> Column:
        return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)

    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_FOLD == 0
    tampered = chosen & F.col("text").rlike("[A-Z]")
    return docs.select(
        F.col("doc_id").cast("long").alias("key"), "source", leaf(F.col("text")).alias("digest"),
        F.when(tampered, leaf(F.translate("text", UPPER, LOWER))).alias("altered"),
    )


def _fold(rows: DataFrame, root: str) -> DataFrame:
    """The proof and the folded root of every leaf of the runs."""
    import pyarrow as pa

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def others(run: str, place: int) -> tuple[str, str]:
        return run[: DIGEST_CHARS * place], run[DIGEST_CHARS * (place + 1) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for closed, members, witness, subroot in zip(*(column.to_pylist() for column in batch.columns)):
                steps = [others(step["run"], step["place"]) for step in witness]
                shared = "".join([left + right for left, right in steps])
                own = "".join([member["digest"] for member in members]) if closed else ""
                for place, member in enumerate(members):
                    left, right = others(own, place)
                    folded = member["altered"] or member["digest"]
                    if closed:
                        folded = joined_digest(left + folded + right)
                    for before, after in steps:
                        folded = joined_digest(before + folded + after)
                    proof = joined_digest(left + right + shared)
                    out.append((member["key"], member["digest"], subroot, root, proof, folded, folded == root))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    # The null source stands before all others, which compare by their bytes.
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    runs, subroots = climb(numbered(leaves(docs), tree, ["key", "digest"]).drop("source"))
    subroots = store(subroots.withColumnRenamed("tree", "source_tree"), "subroots")
    sources = subroots.select("source_tree", F.col("root").alias("digest"))
    # A single tree over all sources; its keys are the places of the sources.
    placed = store(numbered(sources, F.lit(""), ["source_tree"]), "placed-sources")
    top_runs, roots = climb(placed.select("tree", "pos", F.col("pos").alias("key"), "digest", F.lit(None).cast("string").alias("altered"), "n"))
    found = roots.first()
    root = found.root if found else ""
    top = _witness_of_members(top_runs).select(F.col("key").alias("pos"), F.col("above").alias("top"))
    of_source = placed.join(top, "pos").select(F.col("source_tree").alias("tree"), F.col("digest").alias("subroot"), "top")
    whole = runs.join(of_source, "tree").select("closed", "members", F.concat("witness", "above", "top").alias("witness"), "subroot")
    return _fold(whole, root)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text"))
