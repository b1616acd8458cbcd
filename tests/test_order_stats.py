import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from claimgauge.operators import order_stats
from claimgauge.operators.order_stats import (
    exact_median,
    nearest_quantiles,
    nearest_rank,
    number_rows,
    refine,
    select_ranks,
)


def brute_quantile(values, q):
    ordered = sorted(values)
    return ordered[int((len(ordered) - 1) * q + 0.5)]


def brute_median(values):
    ordered, n = sorted(values), len(values)
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(7)
    return {
        "one": [5.0],
        "even": [1.0, 2.0, 3.0, 4.0],
        "ties": [2.5] * 40 + [2.6] * 3,
        "signs": [rng.uniform(-5, 5) for _ in range(101)] + [0.0, -0.0],
        "wide": [rng.choice([1e-9, 1.0, 1e12]) * rng.random() for _ in range(200)],
        "close": [100 + i / 100 for i in range(300)],
        None: [3.0, 1.0, 2.0],
    }


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(key, value) for key, values in groups.items() for value in values] + [("even", None), ("none", None)]
    return spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(5)


def test_quantiles_per_group(table, groups):
    got = {r["g"]: r for r in nearest_quantiles(table, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.9)):
            assert got[key][name] == brute_quantile(values, q), (key, q)


def test_median_per_group_and_overall(table, groups):
    got = {r["g"]: r["m"] for r in exact_median(table, ["g"], "v", "m").collect()}
    assert got == {key: brute_median(values) for key, values in groups.items()}
    everything = [v for values in groups.values() for v in values]
    assert exact_median(table, [], "v", "m").collect()[0]["m"] == brute_median(everything)


def test_no_values(spark):
    empty = spark.createDataFrame([], "v DOUBLE")
    assert [r["m"] for r in exact_median(empty, [], "v", "m").collect()] in ([], [None])


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def every_pass(monkeypatch):
    """No bucket counts as small, so passes go on until each holds one value."""
    monkeypatch.setattr(order_stats, "FEW", 0)


@pytest.mark.parametrize("step", [1.0, 1e-10])
def test_later_passes_read_few_rows(spark, every_pass, monkeypatch, step):
    """Also if all values lie within a hair of each other; nothing is sorted by value or ranged."""
    read, plans, store = [], [], order_stats.materialize

    def counted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        stored = store(df, label)
        if label == "rows-of-buckets":
            read.append(stored.count())
        return stored

    monkeypatch.setattr(order_stats, "materialize", counted)
    table = spark.range(1, 60_001).select((100 + F.col("id") * step).alias("v"))
    assert select_ranks(table, [], "v", {"p90": nearest_rank(0.9)}).collect()[0]["p90"] == 100 + 54_000 * step
    # Within a hair, the first bucket holds every value; from then on next to none are left.
    assert len(read) <= 2 and read[-1] < 60_000 / 32 or step < 1
    assert all(after < 60_000 / 1000 for after in read[1:])
    assert not any("rangepartitioning" in plan for plan in plans)


def bits_to_double(bits):
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


@pytest.mark.parametrize("few", [0, 8, 4096])
def test_any_doubles_settle_in_five_passes(spark, monkeypatch, few):
    """Neighbours, subnormals, the extremes, infinities, and doubles of random bits."""
    monkeypatch.setattr(order_stats, "FEW", few)
    rng = random.Random(3)
    one = struct.unpack("<Q", struct.pack("<d", 1.0))[0]
    groups = {
        "neighbours": [bits_to_double(one + i) for i in range(40)],
        "halves": [bits_to_double(one + (1 << i)) for i in range(46)] + [bits_to_double(one + 1 + (1 << i)) for i in range(1, 46)],
        "subnormal": [i * 5e-324 for i in range(-30, 300)],
        "extremes": [1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324],
        "bits": [v for v in (bits_to_double(rng.getrandbits(64)) for _ in range(500)) if not math.isnan(v)],
        "around one": [bits_to_double(one + rng.getrandbits(45)) for _ in range(500)],
    }
    table = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g STRING, v DOUBLE")
    quantiles = {f"q{i}": i / 10 for i in range(11)}
    found = refine(table, ["g"], "v", {name: nearest_rank(q) for name, q in quantiles.items()})
    assert len(found) <= (5 if few == 0 else 10)
    got = {r["g"]: r for r in nearest_quantiles(table, ["g"], "v", quantiles).collect()}
    for g, values in groups.items():
        for name, q in quantiles.items():
            assert got[g][name] == brute_quantile(values, q), (g, name)


def test_not_a_number_comes_last(spark):
    table = spark.createDataFrame([(1.0,), (float("nan"),), (math.inf,), (-2.0,), (None,)], "v DOUBLE")
    got = select_ranks(table, [], "v", {"first": lambda n: F.lit(1), "third": lambda n: F.lit(3), "last": lambda n: n}).collect()[0]
    assert (got["first"], got["third"]) == (-2.0, math.inf) and math.isnan(got["last"])


@pytest.mark.parametrize("few", [0, 4096])
def test_a_hot_group_and_a_hot_value(spark, monkeypatch, few):
    """Two thirds of all rows in one group, half of them the same value, whole numbers of another type."""
    monkeypatch.setattr(order_stats, "FEW", few)
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 300)).alias("g"),
        F.when(F.col("id") % 2 == 0, 1000).otherwise(F.col("id") % 1013 + 500).cast("int").alias("v"),
    )
    values = {}
    for r in rows.collect():
        values.setdefault(r["g"], []).append(r["v"])
    got = {r["g"]: r["m"] for r in exact_median(rows, ["g"], "v", "m").collect()}
    assert got == {g: brute_median(v) for g, v in values.items()}


def test_row_numbers_over_many_tasks(spark, many_tasks):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id")
    got = number_rows(rows, [F.desc("v"), F.asc("id")], "place").collect()
    ordered = sorted(got, key=lambda r: (-r["v"], r["id"]))
    assert [r["place"] for r in ordered] == list(range(1, 1001))
