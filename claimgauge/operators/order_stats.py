"""Exact quantiles, medians and row numbers without sorting a group in one task.

Ranks are found by refining histograms. The first pass counts the values of each group in buckets of
their sign and logarithm; the bucket that holds a wanted rank is cut into equal parts in the next pass,
which reads the rows of such buckets only, and so on until a bucket holds one value or at most :data:`FEW` rows.
The table is neither sorted nor ranged: counts per bucket are shuffled, summed on the map side first. A bucket's
number never falls as the value grows, so ranks are exact however the values lie and however they are rounded.

Passes end soon. Finite doubles of one first bucket differ by a factor of less than ``e ** (1 / STEPS)``, which at most
2^48 doubles do, and each further pass parts them by 2^16: five passes settle any table, two the usual one. A pass
counts at most :data:`FIRST_BUCKETS` or ``PARTS + 1`` buckets per group and wanted bucket, which bounds its windows.

The table is read once per pass over it, twice as a rule, so one that is dear to derive is better stored first. The bucket
found for each rank, and the rows of large ones, are stored stages, so calling one of these functions runs jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimgauge.operators.stages import materialize

Ranks = dict[str, Callable[[Column], Column]]

#: Buckets of the first pass per factor of e, and parts of a bucket in each later pass.
STEPS, PARTS = 64, 65_536
#: Above the number of any finite magnitude: natural logarithms of doubles lie within -745 and 710.
SHIFT = 50_000
#: Bound of the buckets of one group in the first pass: both signs, zero, infinities and not-a-number.
FIRST_BUCKETS = 2 * (745 + 710) * STEPS + 4
#: A wanted bucket of at most so many rows is ordered in one array.
FEW = 4096
#: Tasks over which the rows of one wanted bucket are spread when they meet it.
SALTS = 8


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """1-based rank of the q-quantile under nearest interpolation."""
    return lambda n: F.floor((n - 1) * q + 0.5) + 1


LOWER_MIDDLE: Callable[[Column], Column] = lambda n: F.floor((n + 1) / 2)
UPPER_MIDDLE: Callable[[Column], Column] = lambda n: F.floor(n / 2) + 1


def magnitude_bucket(value: Column) -> Column:
    """The first pass's bucket of a double; infinities and not-a-number, which orders last, have their own."""
    infinity = F.lit(float("inf"))
    size = F.floor(F.ln(F.abs(value)) * STEPS) + SHIFT
    return (
        F.when(F.isnan(value), 3 * SHIFT)
        .when(F.abs(value) == infinity, F.signum(value) * (2 * SHIFT))
        .when(value == 0, 0)
        .otherwise(F.signum(value) * size)
        .cast("int")
    )


def part_of_bucket(value: Column, low: Column, high: Column) -> Column:
    """The later passes' bucket: the part of ``low`` to ``high`` a value lies in, 0 at the one and ``PARTS`` at the other."""
    return F.floor((value - low) / (high - low) * PARTS).cast("int")


def bucket_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, lowest and highest value per group, slot and bucket, with the rows up to the bucket as ``n_upto``.

    A slot is a bucket of the pass before, named by its lowest value.
    """
    slot = Window.partitionBy(*keys, "slot")
    upto = slot.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.groupBy(*keys, "slot", "bucket")
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .withColumns({"n_slot": F.sum("n").over(slot), "n_upto": F.sum("n").over(upto)})
    )


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def _reached(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets that hold the rank beside them, with the rank counted from the bucket's first row."""
    before = F.col("n_upto") - F.col("n")
    held = counts.where((F.col("rank") > before) & (F.col("rank") <= F.col("n_upto")))
    return held.withColumn("rank", F.col("rank") - before).select(*keys, "slot", "bucket", "n", "low", "high", "pick", "rank")


def first_buckets(rows: DataFrame, keys: list[str], ranks: Ranks) -> DataFrame:
    """The bucket of each wanted rank of each group."""
    wanted = F.array(
        *[F.struct(F.lit(name).alias("pick"), rank(F.col("n_slot")).cast("long").alias("rank")) for name, rank in ranks.items()]
    )
    counts = bucket_counts(rows, keys).withColumn("wanted", F.explode(wanted))
    return _reached(counts.select("*", "wanted.pick", "wanted.rank"), keys)


def next_buckets(rows: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """The same one pass later, where ``found`` has the ranks of the slots that the rows are in."""
    spots = found.select(*[F.col(k).alias(f"spot_{k}") for k in keys], F.col("low").alias("spot_slot"), "pick", "rank")
    return _reached(bucket_counts(rows, keys).join(spots, _same([*keys, "slot"], "spot_")), keys)


def rows_of_buckets(rows: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """The rows in the buckets found, which become their slots, beside the slot's ``high`` and ``picks``.

    A bucket of many rows is met by several tasks where the buckets are too many to be broadcast.
    """
    names = [*keys, "slot", "bucket"]
    buckets = found.groupBy(*names, "low", "high").agg(F.collect_list(F.struct("pick", "rank")).alias("picks"))
    spread = buckets.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    renamed = spread.select(*[F.col(name).alias(f"spot_{name}") for name in [*names, "salt"]], "low", "high", "picks")
    salted = rows.select(*names, "value").withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
    return salted.join(renamed, _same([*names, "salt"], "spot_")).select(*keys, F.col("low").alias("slot"), "high", "picks", "value")


def values_of_small_buckets(rows: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """``keys, pick, value`` of ranks in buckets of at most :data:`FEW` rows, which are ordered in an array."""
    gathered = (
        rows_of_buckets(rows, keys, found)
        .groupBy(*keys, "slot")
        .agg(F.sort_array(F.collect_list("value")).alias("ordered"), F.any_value("picks").alias("picks"))
    )
    picked = gathered.withColumn("picked", F.explode("picks"))
    return picked.select(*keys, "picked.pick", F.element_at("ordered", F.col("picked.rank").cast("int")).alias("value"))


def refine(df: DataFrame, keys: list[str], value: str, ranks: Ranks) -> list[DataFrame]:
    """Tables of ``keys, pick, value``, one or two from each pass, which hold every wanted rank once."""
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, (F.col(value).cast("double") + F.lit(0.0)).alias("value"), F.lit(0.0).alias("slot")
    )
    rows = rows.withColumn("bucket", magnitude_bucket(F.col("value")))
    found = materialize(first_buckets(rows, keys, ranks), "rank-buckets")
    done = []
    # Every pass parts the lowest value of a bucket from its highest, so this ends.
    while True:
        done.append(found.where("low = high").select(*keys, "pick", F.col("low").alias("value")))
        unsettled = found.where("low < high")
        least, most = unsettled.agg(F.min("n"), F.max("n")).first()
        if least is not None and least <= FEW:
            done.append(values_of_small_buckets(rows, keys, unsettled.where(F.col("n") <= FEW)))
        if most is None or most <= FEW:
            return done
        large = unsettled.where(F.col("n") > FEW)
        kept = materialize(rows_of_buckets(rows, keys, large).drop("picks"), "rows-of-buckets")
        rows = kept.withColumn("bucket", part_of_bucket(F.col("value"), F.col("slot"), F.col("high")))
        found = materialize(next_buckets(rows, keys, large), "rank-buckets")


def select_ranks(df: DataFrame, keys: list[str], value: str, ranks: Ranks) -> DataFrame:
    """The values at the given ranks of each group's ascending non-null values, one column per name.

    Groups without a value have no row; without keys there is always one row, null if there is no value.
    """
    found = reduce(DataFrame.union, refine(df, keys, value, ranks))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("pick") == name, F.col("value"))).alias(name) for name in ranks])


def nearest_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles that are values of the data: the one at index ``round((n - 1) * q)``."""
    return select_ranks(df, keys, value, {name: nearest_rank(q) for name, q in quantiles.items()})


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The middle value, or the mean of the two middle values."""
    middles = select_ranks(df, keys, value, {"lower": LOWER_MIDDLE, "upper": UPPER_MIDDLE})
    return middles.select(*keys, ((F.col("lower") + F.col("upper")) / 2).alias(name))


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rows numbered from 1 in the order, which must leave no ties.

    Rows are sorted by range and stored; a row's number is its number in its task plus all rows before it.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sorted-rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select(
        F.col("part").alias("offset_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    numbered = placed.withColumn(name, own).join(offsets, F.col("part") == F.col("offset_part"))
    return numbered.withColumn(name, (F.col(name) + F.col("offset")).cast("int")).drop("part", "offset_part", "offset")
