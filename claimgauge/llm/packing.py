"""Packing token sequences by cutting-stock column generation.

A document is its token ids and an end id. Whole runs of 1024 ids from its start fill sequences of their
own. What remains is cut at a multiple of ``UNIT`` ids: the first part is an item of 1 to 63 units, and
fewer than ``UNIT`` ids are left over. The histogram of item lengths, 63 numbers whatever the corpus, is
all that the driver needs: a linear program over patterns (multisets of lengths that fit a sequence) is
solved by column generation, where knapsack dynamic programming prices new patterns. Patterns that fill
a sequence exactly are rounded down to whole numbers and assigned to the documents by their rank within
their length. Items beyond the rounded numbers, and all rests, form one stream that is cut every 1024
ids; its end is cut into powers of two. So no sequence is padded.

Ranks come from running counts within each task and sums over smaller tasks, so no row has to wait for
another. The table of counts is stored; assignments are arithmetic on it.

A null text is an empty text, which is its end id alone. Repeated rows and ids are packed once each;
other columns are not read; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from claimgauge.llm.common import store
from claimgauge.llm.tokens import encoder

SEQUENCE = 1024
UNIT = 16
UNITS = SEQUENCE // UNIT
END_ID = 0
#: Bound on the pivots of the linear program; any basis on the way is feasible.
MAX_PIVOTS = 3000

_DOCUMENTS = "doc_id {}, part int, n long, full_before long, units int, rank long, rest_before long, full_crcs array<long>, tail binary"
_PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_pattern(prices: dict[int, float], capacity: int = UNITS) -> tuple[float, Counter]:
    """The multiset of lengths of at most ``capacity`` with the highest price, by knapsack dynamic programming."""
    value, last = [0.0] * (capacity + 1), [0] * (capacity + 1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        for length, price in prices.items():
            if length <= room and value[room - length] + price > value[room] + 1e-12:
                value[room], last[room] = value[room - length] + price, length
    pattern, room = Counter(), capacity
    while room > 0:
        if last[room]:
            pattern[last[room]] += 1
            room -= last[room]
        else:
            room -= 1
    return value[capacity], pattern


def solve_patterns(counts: dict[int, int], capacity: int = UNITS) -> list[tuple[Counter, float]]:
    """Patterns and how often each is used, so that all items are covered by the fewest sequences.

    The basis starts with one pattern per length. A priced pattern enters while it is worth more than
    the sequence it takes.
    """
    lengths = sorted(length for length, n in counts.items() if n > 0)
    if not lengths:
        return []
    place = {length: i for i, length in enumerate(lengths)}
    patterns = [Counter({length: capacity // length}) for length in lengths]
    basis = np.diag([float(capacity // length) for length in lengths])
    amounts = np.array([counts[length] for length in lengths], float)
    used = np.linalg.solve(basis, amounts)
    for _ in range(MAX_PIVOTS):
        prices = np.linalg.solve(basis.T, np.ones(len(lengths)))
        worth, pattern = best_pattern({length: prices[i] for length, i in place.items() if prices[i] > 0}, capacity)
        if worth <= 1 + 1e-9:
            break
        column = np.zeros(len(lengths))
        for length, n in pattern.items():
            column[place[length]] = n
        step = np.linalg.solve(basis, column)
        ratios = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(ratios))
        if not np.isfinite(ratios[leaves]):
            break
        basis[:, leaves] = column
        patterns[leaves] = pattern
        used = np.maximum(np.linalg.solve(basis, amounts), 0)
    return list(zip(patterns, used))


def plan_items(counts: dict[int, int]) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], dict[int, int], int]:
    """Where each rank of each length goes.

    Per length: blocks ``(first rank, end rank, first sequence, items per sequence, offset in units)``;
    then the number of placed items per length, and the number of sequences.
    """
    blocks: dict[int, list[tuple[int, int, int, int, int]]] = {}
    placed: dict[int, int] = Counter()
    sequences = 0
    for pattern, times in solve_patterns(counts):
        times = int(times + 1e-6)
        if sum(length * n for length, n in pattern.items()) != UNITS:
            continue
        times = min([times, *((counts[length] - placed[length]) // n for length, n in pattern.items())])
        if times <= 0:
            continue
        offset = 0
        for length, n in sorted(pattern.items()):
            first = placed[length]
            blocks.setdefault(length, []).append((first, first + n * times, sequences, n, offset))
            placed[length] += n * times
            offset += n * length
        sequences += times
    return blocks, dict(placed), sequences


def _measure(source: DataFrame, path: str) -> DataFrame:
    """Every document with the crcs of its full runs, the ids after them, and its running counts in the task."""
    import pyarrow as pa
    from pyspark import TaskContext

    kind = source.schema["doc_id"].dataType.simpleString()
    schema = T._parse_datatype_string(_DOCUMENTS.format(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        part = TaskContext.get().partitionId()
        tokens = encoder(path)
        end = END_ID.to_bytes(tokens.width, "little")
        full_before = rest_before = 0
        ranks = [0] * UNITS
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = tokens.encode(text.as_py() or "") + end
                n = len(data) // tokens.width
                ids = np.frombuffer(data, tokens.dtype)
                full, remains = divmod(n, SEQUENCE)
                wide = ids.astype("<u4")
                crcs = [zlib.crc32(wide[k * SEQUENCE : (k + 1) * SEQUENCE]) for k in range(full)]
                units, rest = divmod(remains, UNIT)
                rows.append((part, n, full_before, units, ranks[units], rest_before, crcs, wide[full * SEQUENCE :].astype(tokens.dtype).tobytes()))
                ranks[units] += 1
                full_before += full
                rest_before += rest
            columns = [batch.column(0)] + [pa.array(c, target.field(i + 1).type) for i, c in enumerate(zip(*rows))]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return source.mapInArrow(run, schema)


def _stream_cuts(total: int) -> list[int]:
    """Starts of the last, shorter sequences of the stream: powers of two, and the end of the stream."""
    at, left = total - total % SEQUENCE, total % SEQUENCE
    cuts = [at]
    while left:
        power = 1 << left.bit_length() - 1
        at, left = at + power, left - power
        cuts.append(at)
    return cuts


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece of every document: where it lies in the document and in its sequence."""
    import pyarrow as pa

    source = docs.select("doc_id", "text")
    measured = store(_measure(source, tokenizer_path), "token-counts")
    by_part = measured.groupBy("part", "units").agg(
        F.count("*").alias("n_items"),
        F.sum(F.size("full_crcs")).alias("n_full"),
        F.sum((F.col("n") % UNIT)).alias("n_rest"),
    )
    by_part = store(by_part, "part-counts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = by_part.groupBy("part").agg(F.sum("n_full").alias("n_full"), F.sum("n_rest").alias("n_rest")).select(
        "part",
        F.coalesce(F.sum("n_full").over(before), F.lit(0)).alias("full_base"),
        F.coalesce(F.sum("n_rest").over(before), F.lit(0)).alias("rest_base"),
    )
    of_length = Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_part.select("part", "units", F.coalesce(F.sum("n_items").over(of_length), F.lit(0)).alias("rank_base"))
    bases = ranks.join(sums, "part")

    histogram = {
        row["units"]: (row["items"], row["full"], row["rest"])
        for row in by_part.groupBy("units")
        .agg(F.sum("n_items").alias("items"), F.sum("n_full").alias("full"), F.sum("n_rest").alias("rest"))
        .collect()
    }
    counts = {units: items for units, (items, _, _) in histogram.items() if units}
    blocks, placed, n_packed = plan_items(counts)
    first_packed = sum(full for _, full, _ in histogram.values())
    first_stream = first_packed + n_packed
    # Items without a place lie at the start of the stream, by length; the rests follow.
    stream_base, at = {}, 0
    for units, n in sorted(counts.items()):
        stream_base[units] = at
        at += (n - placed.get(units, 0)) * units * UNIT
    rest_start = at
    total = rest_start + sum(rest for _, _, rest in histogram.values())
    cuts = _stream_cuts(total)
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = T._parse_datatype_string(_PIECES.format(kind))

    def stream_pieces(position: int, length: int):
        """``(ids from the start, length, sequence, offset)`` of a stretch of the stream, cut at its sequences."""
        done = 0
        while done < length:
            at = position + done
            if at < cuts[0]:
                sequence, offset = divmod(at, SEQUENCE)
                room = SEQUENCE - offset
            else:
                k = next(i for i in range(len(cuts) - 1) if at < cuts[i + 1])
                sequence, offset, room = cuts[0] // SEQUENCE + k, at - cuts[k], cuts[k + 1] - at
            size = min(room, length - done)
            yield done, size, first_stream + sequence, offset
            done += size

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            took, rows = [], []
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names if name != "doc_id"}
            for i in range(batch.num_rows):
                row = {name: values[i] for name, values in columns.items()}
                n, units = row["n"], row["units"]
                crcs, tail = row["full_crcs"], row["tail"]
                rest = n % UNIT
                start = n - n % SEQUENCE
                ids = np.frombuffer(tail, f"<u{len(tail) // (n % SEQUENCE)}" if tail else "<u2").astype("<u4")
                found = [
                    (k * SEQUENCE, SEQUENCE, crc, row["full_base"] + row["full_before"] + k, 0) for k, crc in enumerate(crcs)
                ]
                crc_of = lambda a, b, ids=ids: zlib.crc32(ids[a:b])
                size = units * UNIT
                if units:
                    rank = row["rank_base"] + row["rank"]
                    block = next((b for b in blocks.get(units, ()) if b[0] <= rank < b[1]), None)
                    if block:
                        first, _, sequence, each, offset = block
                        which, slot = divmod(rank - first, each)
                        found.append((start, size, crc_of(0, size), first_packed + sequence + which, (offset + slot * units) * UNIT))
                    else:
                        place = stream_base[units] + (rank - placed.get(units, 0)) * size
                        for done, length, sequence, offset in stream_pieces(place, size):
                            found.append((start + done, length, crc_of(done, done + length), sequence, offset))
                place = rest_start + row["rest_base"] + row["rest_before"]
                for done, length, sequence, offset in stream_pieces(place, rest):
                    found.append((start + size + done, length, crc_of(size + done, size + done + length), sequence, offset))
                rows += [(a, b, c, n, d, e) for a, b, c, d, e in found]
                took += [i] * len(found)
            if rows:
                arrays = [batch.column("doc_id").take(pa.array(took))] + [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return measured.join(bases, ["part", "units"]).mapInArrow(emit, schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
