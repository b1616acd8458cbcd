"""Chat transcripts turned into roles and turns by a hidden Markov model, and rendered canonically.

A transcript is plain lines. Some begin with a speaker marker, in whatever style; others have to be told
from their surroundings. The states are a role together with ``begin``, ``open``, ``inside`` or ``blank``; a line is
observed as its marker (hashed), its length class and whether it asks something. Start, transition and emission
weights are smoothed counts of labelled transcripts, as whole numbers, so that sums are exact.

Lines are sorted over all tasks, and what a task holds of one transcript is a block. For every block
the best score from each entering to each leaving state is found, a small matrix; the matrices of a
transcript, as many as there are tasks at most, are chained to fix the states at the block borders; then every block
is traced back alone. So a transcript may hold any share of all lines and Viterbi's path is still that of
the whole. Equal scores are told apart by small fixed weights.

Empty lines before the first turn belong to none. Null lines are empty lines. A null id is a transcript of its own. Repeated lines count as often as they
occur. Other columns are not read. An empty table gives no turns.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from claimgauge.llm.common import row_identity, store

ROLES = ("assistant", "system", "user")
#: A turn begins right after another one, or opens after an empty line.
KINDS = ("begin", "open", "inside", "blank")
_BEGIN, _OPEN, _INSIDE, _BLANK = range(4)
STATES = tuple(f"{role}:{kind}" for role in ROLES for kind in KINDS)
#: Marker words are hashed into so many classes; class 0 is no marker.
MARKERS = 128
LENGTHS = 4
OBSERVATIONS = MARKERS * LENGTHS * 2
#: Weights are logarithms in these units.
SCALE = 1 << 20
_NEVER = -(1 << 50)

_MARKER = r"^[ \t]*(#{1,6}[ \t]*|<\||\[|\*\*)?([A-Za-z]{1,20})(\|>|\][:]?|:\*\*|\*\*:?|:|[ \t]*$)[ \t]*"

# How the registered query writes speakers. Placeholders stand for the words of each style.
STYLES = (
    ("{}: ", {"user": "User", "assistant": "Assistant", "system": "System"}),
    ("{}: ", {"user": "Human", "assistant": "AI", "system": "Instructions"}),
    ("### {}\n", {"user": "User", "assistant": "Response", "system": "System"}),
    ("<|{}|>\n", {"user": "user", "assistant": "assistant", "system": "system"}),
    ("{}: ", {"user": "Q", "assistant": "A", "system": "S"}),
)
#: One in so many turns is written without a marker, after an empty line; one in so many others has that line, too.
UNMARKED, GAP = 7, 3


def observation(line: Column) -> Column:
    """What the model sees of a line: a number below ``OBSERVATIONS``."""
    before, word, after = (F.regexp_extract(line, _MARKER, i) for i in (1, 2, 3))
    marked = (word != "") & ((before != "") | (after.rlike("[:|\\]*]")))
    name = F.concat_ws(" ", F.trim(before), F.lower(word), F.trim(after))
    marker = F.when(marked, F.pmod(F.xxhash64(name), F.lit(MARKERS - 1)) + 1).otherwise(0)
    size = F.char_length(F.trim(line))
    length = F.when(size == 0, 0).when(size < 20, 1).when(size < 120, 2).otherwise(3)
    asks = F.trim(line).endswith("?").cast("int")
    return ((marker * LENGTHS + length) * 2 + asks).cast("int")


def without_marker(line: Column) -> Column:
    word, before, after = F.regexp_extract(line, _MARKER, 2), F.regexp_extract(line, _MARKER, 1), F.regexp_extract(line, _MARKER, 3)
    marked = (word != "") & ((before != "") | after.rlike("[:|\\]*]"))
    return F.when(marked, F.regexp_replace(line, _MARKER, "")).otherwise(line)


@dataclasses.dataclass(frozen=True)
class RoleModel:
    """Whole-number weights: ``start`` and ``step`` over states, ``shows`` per state and observation."""

    start: np.ndarray
    step: np.ndarray
    shows: np.ndarray

    def matrix(self, seen: np.ndarray) -> np.ndarray:
        """Best score from each entering state, before the block, to each state of its last line."""
        best = np.where(np.eye(len(STATES), dtype=bool), 0, _NEVER).astype(np.int64)
        for o in seen:
            best = np.max(best[:, :, None] + self.step[None, :, :], axis=1) + self.shows[:, o]
            best = np.maximum(best, _NEVER)
        return best

    def path(self, seen: np.ndarray, entry: int | None, leave: int | None) -> np.ndarray:
        """The best states of a block, with the state before it and that of its last line given or free."""
        scores = (self.start if entry is None else self.step[entry]) + self.shows[:, seen[0]]
        back = np.zeros((len(seen), len(STATES)), np.int8)
        for t, o in enumerate(seen[1:], 1):
            ways = scores[:, None] + self.step
            back[t] = np.argmax(ways, axis=0)
            scores = np.max(ways, axis=0) + self.shows[:, o]
        states = np.zeros(len(seen), np.int64)
        states[-1] = int(np.argmax(scores)) if leave is None else leave
        for t in range(len(seen) - 1, 0, -1):
            states[t - 1] = back[t, states[t]]
        return states

    def borders(self, first: np.ndarray, matrices: list[np.ndarray]) -> list[int]:
        """The state of the last line of every block of one transcript; ``first`` are the scores after the first."""
        scores = [first]
        for m in matrices:
            scores.append(np.max(scores[-1][:, None] + m, axis=0))
        found = [int(np.argmax(scores[-1]))]
        for before, m in zip(scores[-2::-1], matrices[::-1]):
            found.append(int(np.argmax(before + m[:, found[-1]])))
        return found[::-1]


def _tie(*place: int) -> int:
    """A small weight of its own for each place."""
    return zlib.crc32(repr(place).encode()) % 64


def _weights(counts: dict, rows: int, columns: int, smooth: float) -> np.ndarray:
    out = np.zeros((rows, columns), np.int64)
    for i in range(rows):
        total = sum(counts.get((i, j), 0) for j in range(columns)) + smooth * columns
        for j in range(columns):
            out[i, j] = round(math.log((counts.get((i, j), 0) + smooth) / total) * SCALE) + _tie(rows, i, j)
    return out


def fit_roles(labelled: DataFrame) -> RoleModel:
    """From ``conv_id, turn, role, lines`` (an array of the turn's lines): weights from smoothed counts.

    An empty line ahead of a turn counts as a blank of its role. Steps within a turn are counted in its
    row, steps between turns by a join with the next turn's first state. Only counts reach the driver, as
    many as there are states and observations at most.
    """
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    full = F.transform("lines", lambda line: F.trim(line) != "")
    known = labelled.where(F.col("role").isin(*ROLES) & (F.size("lines") > 0)).select(
        "conv_id", "turn", (role * len(KINDS)).alias("base"), (F.array_position(full, True) - 1).cast("int").alias("first"), "lines"
    )
    kind = lambda line, i: (
        F.when(F.trim(line) == "", _BLANK).when(i != F.col("first"), _INSIDE).when(i > 0, _OPEN).otherwise(_BEGIN)
    )
    turns = known.select(
        "conv_id", "turn", "lines", F.transform("lines", lambda line, i: F.col("base") + kind(line, i)).alias("states")
    )
    shown = turns.select(F.explode(F.arrays_zip("states", "lines")).alias("z"))
    emitted = shown.groupBy(F.col("z.states").alias("a"), observation(F.col("z.lines")).alias("b")).agg(F.count("*").alias("n"))
    within = turns.select(F.explode(F.arrays_zip(F.col("states").alias("a"), F.expr("slice(states, 2, size(states))").alias("b"))).alias("z"))
    ends = turns.groupBy("conv_id", "turn").agg(F.min(F.element_at("states", -1)).alias("a"))
    heads = turns.groupBy(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t")).agg(F.min(F.get("states", F.lit(0))).alias("b"))
    between = ends.join(heads, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")))
    steps = within.select("z.a", "z.b").union(between.select("a", "b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    starts = turns.where("turn = 0").groupBy(F.lit(0).alias("a"), F.get("states", F.lit(0)).alias("b")).agg(F.count("*").alias("n"))
    counts = [{(r["a"], r["b"]): r["n"] for r in counted.collect()} for counted in (starts, steps, emitted)]
    # Marker, length and question are taken as independent within a state, so that unseen combinations still tell.
    number = np.arange(OBSERVATIONS)
    shows = np.zeros((len(STATES), OBSERVATIONS), np.int64)
    for part, size, smooth in ((number // (LENGTHS * 2), MARKERS, 0.01), (number // 2 % LENGTHS, LENGTHS, 0.5), (number % 2, 2, 0.5)):
        summed: dict[tuple[int, int], int] = {}
        for (state, seen), n in counts[2].items():
            key = state, int(part[seen])
            summed[key] = summed.get(key, 0) + n
        shows += _weights(summed, len(STATES), size, smooth)[:, part]
    return RoleModel(
        _weights(counts[0], 1, len(STATES), 0.5)[0],
        _weights(counts[1], len(STATES), len(STATES), 0.1),
        shows,
    )


def recover_roles(lines: DataFrame, order: list[str], model: RoleModel) -> DataFrame:
    """``conv_id, pos, line, turn, role`` of every line of ``conv_id, line`` and the ``order`` columns."""
    import pyarrow as pa

    kind = lines.schema["conv_id"].dataType.simpleString()
    text = F.coalesce("line", F.lit(""))
    sorted_lines = lines.select("conv_id", text.alias("line"), *[F.col(c).alias(f"order_{i}") for i, c in enumerate(order)])
    keys = ["conv_id", *[f"order_{i}" for i in range(len(order))], "line"]
    placed = row_identity(
        sorted_lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "line", observation(F.col("line")).alias("seen")),
        "chat-lines",
    )
    blocks = store(
        placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "seen"))).alias("rows")),
        "chat-blocks",
    )
    split = Window.partitionBy("conv_id")
    several = blocks.select("conv_id", "part", F.col("rows.seen").alias("seen")).join(
        blocks.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("part").alias("first_part")).where("n > 1").withColumnRenamed("conv_id", "c"),
        F.col("conv_id").eqNullSafe(F.col("c")),
    )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seen, first in zip(batch.column(2), batch.column(3).to_pylist()):
                o = seen.values.to_numpy(zero_copy_only=False)
                if first:
                    rest = model.matrix(o[1:]) if len(o) > 1 else None
                    scores = model.start + model.shows[:, o[0]]
                    out.append((scores if rest is None else np.max(scores[:, None] + rest, axis=0)).tolist())
                else:
                    out.append(model.matrix(o).reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["conv_id", "part", "m"])

    scored = several.select("conv_id", "part", "seen", (F.col("part") == F.col("first_part")).alias("first")).mapInArrow(
        matrices, f"conv_id {kind}, part int, m array<long>"
    )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, parts, entries, leaves = [], [], [], []
            for i, chained in enumerate(batch.column(1).to_pylist()):
                found = [(b["part"], np.array(b["m"], np.int64)) for b in chained]
                borders = model.borders(found[0][1], [m.reshape(len(STATES), -1) for _, m in found[1:]])
                which += [i] * len(found)
                parts += [p for p, _ in found]
                entries += [None, *borders[:-1]]
                leaves += borders
            columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(parts, pa.int32()), pa.array(entries, pa.int32()), pa.array(leaves, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["c", "p", "entry", "leave"])

    chained = scored.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "m"))).alias("blocks"))
    borders = chained.mapInArrow(chain, f"c {kind}, p int, entry int, leave int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, begins = [], []
            for seen, entry, leave in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                path = model.path(seen.values.to_numpy(zero_copy_only=False), entry, leave)
                role, kind_of = path // len(KINDS), path % len(KINDS)
                before = np.concatenate(([-1 if entry is None else entry // len(KINDS)], role[:-1]))
                new = (kind_of <= _OPEN) | (role != before) & (kind_of != _BLANK)
                full = np.flatnonzero(seen.values.to_numpy(zero_copy_only=False) // 2 % LENGTHS > 0)
                if entry is None and len(full) and not new[: full[0] + 1].any():
                    new[full[0]] = True  # the first line of a transcript that has text begins a turn
                states.append(role.tolist())
                begins.append(np.cumsum(new).tolist())
            columns = [batch.column(0), batch.column(1), pa.array(states, pa.list_(pa.int32())), pa.array(begins, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "roles", "turns"])

    given = blocks.join(borders, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    traced = store(
        given.select("conv_id", "part", F.col("rows.seen").alias("seen"), "entry", "leave").mapInArrow(
            trace, f"conv_id {kind}, part int, roles array<int>, turns array<int>"
        ),
        "chat-roles",
    )
    upto = split.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = traced.withColumn("before", F.coalesce(F.sum(F.element_at("turns", -1)).over(upto), F.lit(0)))
    spread = numbered.select("conv_id", "part", "before", F.posexplode(F.arrays_zip("roles", "turns")).alias("i", "z"))
    per_line = spread.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), "i",
        (F.col("before") + F.col("z.turns") - 1).alias("turn"),
        F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("z.roles") + 1).alias("role"),
    )
    places = blocks.select("conv_id", "part", F.posexplode("rows.pos").alias("i", "pos"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (places["i"] == per_line["i"])
    roles = places.join(per_line, on).select("pos", "turn", "role")
    found = placed.select("conv_id", "pos", "line").join(roles, "pos").where((F.col("turn") >= 0) | (F.trim("line") != ""))
    return found.withColumn("turn", F.greatest("turn", F.lit(0)))


def recovered_turns(lines: DataFrame, order: list[str], model: RoleModel) -> DataFrame:
    """``conv_id, turn, role, content`` of every turn, its lines in order without the marker.

    A turn is one value here, as a document's text is.
    """
    found = recover_roles(lines, order, model)
    gathered = found.groupBy("conv_id", "turn").agg(
        F.min_by("role", "pos").alias("role"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines")
    )
    first = without_marker(F.get("lines.line", F.lit(0)))
    rest = F.slice("lines.line", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    content = F.array_join(F.concat(F.array(first), rest), "\n")
    return gathered.select("conv_id", "turn", "role", F.btrim(content, F.lit(" \t\n\r")).alias("content"))


def render(role: Column, content: Column) -> Column:
    """One turn in the canonical form; its marks inside a content are broken up, so they cannot be forged."""
    safe = F.regexp_replace(content, r"<\|(im_start|im_end)\|>", "<| $1 |>")
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), safe, F.lit("<|im_end|>\n"))


def written_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, lines``: every turn as a transcript would show it.

    The style is chosen by the conversation's id. Some turns lack a marker, and some come after an empty line.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    style = F.pmod(F.crc32(F.concat(F.lit("style"), key)), F.lit(len(STYLES)))
    bare = F.col("role").isNull() | (F.pmod(F.crc32(F.concat(key, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit("")))), F.lit(UNMARKED)) == 0)
    marker = F.lit(None).cast("string")
    for number, (form, words) in enumerate(STYLES):
        for role, word in words.items():
            marker = F.when((style == number) & (F.col("role") == role), F.lit(form.format(word))).otherwise(marker)
    text = F.coalesce("text", F.lit(""))
    gap = F.when(F.pmod(F.crc32(F.concat(F.lit("gap"), key, F.coalesce(F.col("turn").cast("string"), F.lit("")))), F.lit(GAP)) == 0, "\n").otherwise("")
    shown = F.when(bare | marker.isNull(), F.concat(F.lit("\n"), text)).otherwise(F.concat(gap, marker, text))
    return conversations.select("conv_id", "turn", "role", F.split(shown, "\n").alias("lines"))


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    """Transcripts written from the conversations, and their turns as recovered from the lines alone.

    The model learns from conversations whose crc32(conv_id as text) mod 5 is not 0.
    """
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    written = written_turns(conversations)
    held_out = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(5)) == 0
    model = fit_roles(written.where(~held_out))
    lines = written.select("conv_id", F.col("turn").alias("place"), F.posexplode("lines").alias("number", "line"))
    turns = recovered_turns(lines, ["place", "number"], model)
    return turns.select("conv_id", "turn", "role", render(F.col("role"), F.col("content")).alias("rendered"), held_out.alias("held_out"))
