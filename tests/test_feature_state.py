"""Features of a table that grows by batches, from merged states alone."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimgauge.operators import feature_state, features


def random_claims(make_claims, seed, n):
    rng = random.Random(seed)
    return make_claims(
        *[
            {
                "claim_id": f"{seed}-{i}", "provider_id": rng.choice(["P1", "P2", "HOT", "HOT", None]), "member_id": f"M{rng.randrange(9)}",
                "procedure_code": rng.choice(["CPT-70100", "CPT-99201", "HCPCS-E0101", None]), "specialty": rng.choice(["A", "B"]),
                "service_date": dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(90)), "units": rng.choice([1, 2, 7]),
                "allowed_amount": rng.choice([0.1, 0.2, 1e9 + 0.01, -3.3]), "billed_amount": rng.randrange(100) / 10,
                "denial_flag": rng.choice(["Y", "N", None]), "network_status": rng.choice(["INN", "OON"]),
            }
            for i in range(n)
        ]
    )


def rows(df):
    return sorted(map(str, df.collect()))


def same_features(state, claims):
    got, tagged = feature_state.features_from_state(state), features.all_features(claims)
    for name in ("provider", "temporal", "service_category"):
        assert got[name].columns == tagged[name].columns
        assert rows(got[name]) == rows(tagged[name]), name


def test_merged_states_equal_all_claims(make_claims):
    batches = [random_claims(make_claims, seed, n) for seed, n in ((1, 120), (2, 1), (3, 60))]
    state, union = feature_state.feature_state(batches[0]), batches[0]
    for batch in batches[1:]:
        state, union = feature_state.merge_states(state, feature_state.feature_state(batch)), union.unionByName(batch)
    same_features(state, union)
    nothing = feature_state.feature_state(union.limit(0))
    same_features(feature_state.merge_states(nothing, state), union)


def test_a_batch_reads_no_earlier_claims(spark, make_claims, tmp_path):
    root, base, batch = f"{tmp_path}/state", f"{tmp_path}/base", f"{tmp_path}/batch"
    first, second = random_claims(make_claims, 4, 80), random_claims(make_claims, 5, 40)
    first.write.parquet(base)
    second.write.parquet(batch)
    assert feature_state.append_to_state(spark, root, spark.read.parquet(base), "base") == 1
    state = feature_state.merge_states(feature_state.load_state(spark, root), feature_state.feature_state(spark.read.parquet(batch)))
    for table in state.values():
        assert not any(base + "/" in name for name in table.inputFiles())
    assert feature_state.append_to_state(spark, root, spark.read.parquet(batch), "batch") == 2
    # A name that the state holds counts once.
    assert feature_state.append_to_state(spark, root, spark.read.parquet(batch), "batch") == 2
    same_features(feature_state.load_state(spark, root), first.unionByName(second))


def test_a_failed_batch_leaves_the_last_state(spark, make_claims, tmp_path):
    root, claims = f"{tmp_path}/state", random_claims(make_claims, 6, 50)
    with pytest.raises(FileNotFoundError):
        feature_state.load_state(spark, root)
    feature_state.append_to_state(spark, root, claims, "one")
    bad = claims.withColumn("units", F.raise_error(F.lit("broken batch")).cast("long"))
    with pytest.raises(Exception, match="broken batch"):
        feature_state.append_to_state(spark, root, bad, "two")
    assert feature_state.last_version(spark, root) == 1
    same_features(feature_state.load_state(spark, root), claims)
    assert feature_state.append_to_state(spark, root, claims, "two") == 2
