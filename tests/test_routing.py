"""Claims that arrive as files: every row once in one of two sinks, however often the stream starts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimgauge.operators.validation import route_valid_rows
from claimgauge.streaming import routing


def lot(make_claims, seed):
    return make_claims(
        *[
            {"claim_id": f"{seed}-{i}", "units": 0 if i % 3 == 0 else 1, "denial_flag": "Y" if i % 5 == 0 else "N",
             "member_id": None if i % 7 == 0 else "M", "service_date": dt.date(2024, 1, 1 + i % 20)}
            for i in range(30)
        ]
    )


def ids(df):
    return sorted(r.claim_id for r in df.select("claim_id").collect())


def test_restarts_add_no_row_twice(spark, make_claims, tmp_path):
    source, target = f"{tmp_path}/claims", f"{tmp_path}/routed"
    everything = None
    for seed in (1, 2, 3):
        claims = lot(make_claims, seed)
        claims.repartition(3).write.mode("append").parquet(source)
        everything = claims if everything is None else everything.unionByName(claims)
        routing.route_arrived(spark, source, target, claims.schema, files_per_batch=2)
        routing.route_arrived(spark, source, target, claims.schema, files_per_batch=2)
        expected = route_valid_rows(everything)
        found = routing.load_routed(spark, target)
        assert ids(found["valid"]) == ids(expected.where(F.size("failed_rules") == 0))
        want = sorted((r.claim_id, r.failed_rules) for r in expected.where(F.size("failed_rules") > 0).collect())
        assert sorted((r.claim_id, r.failed_rules) for r in found["rejected"].select("claim_id", "failed_rules").collect()) == want
    assert found["valid"].columns == everything.columns


def test_a_failure_is_made_up_for(spark, make_claims, tmp_path):
    source, target = f"{tmp_path}/claims", f"{tmp_path}/routed"
    claims = lot(make_claims, 4)
    claims.repartition(2).write.parquet(source)
    broken = tmp_path / "claims" / "part-broken.parquet"
    broken.write_bytes(b"not a parquet file")
    with pytest.raises(Exception):
        routing.route_arrived(spark, source, target, claims.schema, files_per_batch=1)
    for query in spark.streams.active:
        query.stop()
    broken.unlink()
    lot(make_claims, 5).write.mode("append").parquet(source)
    with spark_conf(spark, "spark.sql.files.ignoreMissingFiles", "true"):
        routing.route_arrived(spark, source, target, claims.schema, files_per_batch=1)
    found = routing.load_routed(spark, target)
    assert sorted(ids(found["valid"]) + ids(found["rejected"])) == sorted(ids(claims) + ids(lot(make_claims, 5)))


class spark_conf:
    def __init__(self, spark, key, value):
        self.conf, self.key, self.value = spark.conf, key, value

    def __enter__(self):
        self.conf.set(self.key, self.value)

    def __exit__(self, *error):
        self.conf.unset(self.key)
