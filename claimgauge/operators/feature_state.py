"""Features of a growing claims table without reading its old claims again.

The state of a claims table holds partial sums that merge: per provider and code, per provider and member, per
day, and per service category. The state of two tables together is the merge of their states, and features come
from states alone, equal to those of all claims at once. Counts, sums of money (whole units and millionths),
earliest and latest dates merge exactly in any order; distinct codes and members are kept as distinct pairs.

States are stored in numbered folders under one root. A batch reads the last state and itself, never earlier
claims. A new state is complete once Spark has committed its tables and written its marker, so a run that fails leaves
the last state as it was, and the batch can be given again. Every batch bears a name, and a state knows the names that it
holds: a batch that is given twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimgauge.operators import features

State = dict[str, DataFrame]

#: The tables of a state: their keys, and how partial rows of equal keys become one.
PARTS = {
    "provider": (features.provider_parts, features.merge_provider_parts),
    "member": (features.member_pairs, features.merge_member_pairs),
    "day": (features.daily_parts, features.merge_daily_parts),
    "category": (features.category_parts, features.merge_category_parts),
}


def feature_state(claims: DataFrame) -> State:
    """The state of a claims table."""
    return {name: parts(claims) for name, (parts, _) in PARTS.items()}


def merge_states(first: State, second: State) -> State:
    """The state of both tables together."""
    return {name: merge(first[name].unionByName(second[name])) for name, (_, merge) in PARTS.items()}


def features_from_state(state: State) -> dict[str, DataFrame]:
    """The three feature tables of the claims that the state stands for."""
    return {
        "provider": features.provider_features_from(state["provider"], state["member"]),
        "temporal": features.rolling_claims(features.period_totals_from(state["day"], "weekly", "monthly")),
        "service_category": features.category_features_from(state["category"]),
    }


def _store_of(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def last_version(spark: SparkSession, root: str) -> int:
    """The number of the last complete state, 0 if there is none."""
    store, folder = _store_of(spark, root)
    if not store.exists(folder):
        return 0
    names = [entry.getPath() for entry in store.listStatus(folder)]
    # The batches are written last, so their marker completes a state.
    complete = [p.getName() for p in names if store.exists(_store_of(spark, f"{root}/{p.getName()}/batches/_SUCCESS")[1])]
    return max((int(name) for name in complete if name.isdigit()), default=0)


def load_state(spark: SparkSession, root: str, version: int | None = None) -> State:
    version = version or last_version(spark, root)
    if not version:
        raise FileNotFoundError(f"no feature state in {root}")
    return {name: spark.read.parquet(f"{root}/{version}/{name}") for name in PARTS}


def append_to_state(spark: SparkSession, root: str, batch: DataFrame, batch_name: str) -> int:
    """Merge a batch of claims into the stored state; returns the number of the state that holds it.

    The batch is read once per table of the state, so it should be stored, not derived anew each time.
    """
    version = last_version(spark, root)
    state = feature_state(batch)
    batches = spark.createDataFrame([(batch_name,)], "batch STRING")
    if version:
        held = spark.read.parquet(f"{root}/{version}/batches")
        if not held.where(held.batch == batch_name).isEmpty():
            return version
        state = merge_states(load_state(spark, root, version), state)
        batches = held.union(batches)
    for name, table in state.items():
        table.write.mode("overwrite").parquet(f"{root}/{version + 1}/{name}")
    batches.coalesce(1).write.mode("overwrite").parquet(f"{root}/{version + 1}/batches")
    return version + 1
