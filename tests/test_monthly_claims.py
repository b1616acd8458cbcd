"""Claims by month: replaced months, and which of them a question reads."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimgauge.config import PolicyChangeEvent
from claimgauge.operators.policy_events import policy_impact, window_filter
from claimgauge.sources.monthly_claims import deal_by_month, load_claims_by_month, save_claims_by_month, write_months

EVENT = PolicyChangeEvent("EV-1", ("CPT-99",), "removed", dt.date(2024, 6, 3))


@pytest.fixture(scope="module")
def claims(make_claims):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=3 * i) for i in range(120)]
    dated = make_claims(*[{"claim_id": f"C{i}", "service_date": day, "units": i} for i, day in enumerate(days)], {"claim_id": "N"})
    return dated.withColumn("service_date", F.when(F.col("claim_id") != "N", F.col("service_date")))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_round_trip_and_replaced_months(spark, claims, tmp_path):
    path = save_claims_by_month(claims, str(tmp_path / "claims"))
    loaded = load_claims_by_month(spark, path)
    assert rows(loaded.drop("service_month")) == rows(claims) and dict(loaded.dtypes)["service_month"] == "date"
    may = claims.where("service_date >= '2024-05-01' AND service_date < '2024-06-01' AND units % 2 = 0")
    for _ in range(2):
        save_claims_by_month(may, path)
        kept = claims.where("service_date IS NULL OR NOT (service_date >= '2024-05-01' AND service_date < '2024-06-01')").union(may)
        assert rows(load_claims_by_month(spark, path).drop("service_month")) == rows(kept)
    save_claims_by_month(claims.limit(0), path)
    assert load_claims_by_month(spark, path).count() == kept.count()
    with pytest.raises(ValueError):
        save_claims_by_month(loaded, path)


def test_only_months_of_the_windows_are_read(spark, claims, tmp_path):
    loaded = load_claims_by_month(spark, save_claims_by_month(claims, str(tmp_path / "claims")))
    filtered, impact = window_filter(loaded, EVENT.effective_date, 4), policy_impact(loaded, [EVENT])
    expected = rows(window_filter(claims, EVENT.effective_date, 4)), rows(policy_impact(claims, [EVENT]))
    outside = ("2024-01-01", "2024-02-01", "2024-10-01", "2024-11-01", "2024-12-01", "__HIVE_DEFAULT_PARTITION__")
    damaged = [file for month in outside for file in glob.glob(f"{tmp_path}/claims/service_month={month}/*.parquet")]
    assert len(damaged) >= 5
    for file in damaged:
        with open(file, "wb") as out:
            out.write(b"no parquet")
    assert (rows(filtered.drop("service_month")), rows(impact)) == expected
    with pytest.raises(Exception):
        loaded.agg({"units": "sum"}).collect()
    plan = impact._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan


def test_a_large_month_is_written_by_several_tasks(spark, claims, tmp_path):
    one = spark.range(4000).crossJoin(claims.where("claim_id = 'C3'")).selectExpr("concat('C', id) AS claim_id", *[c for c in claims.columns if c != "claim_id"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        save_claims_by_month(one, str(tmp_path / "claims"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{tmp_path}/claims/service_month=2024-01-01/*.parquet")) == 4


def test_claims_may_be_derived_after_dealing(spark, claims, tmp_path):
    """The same months and rows as by saving the derived claims, with codes in order within each file."""
    narrow = claims.select("claim_id", "service_date", F.concat(F.lit("CPT-"), F.col("units") % 7).alias("procedure_code"), "units")

    def derived(rows):
        return rows.withColumn("note", F.concat_ws("/", "claim_id", "procedure_code", F.col("units") * 2))

    dealt = write_months(derived(deal_by_month(narrow, "units")), str(tmp_path / "dealt"))
    saved = save_claims_by_month(derived(narrow), str(tmp_path / "saved"))
    loaded = load_claims_by_month(spark, dealt)
    assert rows(loaded) == rows(load_claims_by_month(spark, saved)) and loaded.count() == claims.count()
    for file in glob.glob(f"{dealt}/*/*.parquet"):
        codes = [row[0] for row in spark.read.parquet(file).select("procedure_code").coalesce(1).collect()]
        assert codes == sorted(codes)
    with pytest.raises(ValueError):
        deal_by_month(loaded, "units")


def test_months_are_compressed_tightly(spark, claims, tmp_path):
    """Every file of a save, and of a batch that replaces months, whatever the session compresses by."""
    path = save_claims_by_month(claims, str(tmp_path / "claims"))
    save_claims_by_month(claims.where("service_date >= '2024-05-01'"), path)
    files = glob.glob(f"{path}/*/*.parquet")
    groups = [pq.ParquetFile(file).metadata.row_group(0) for file in files]
    assert len(files) >= 13 and {group.column(i).compression for group in groups for i in range(group.num_columns)} == {"ZSTD"}
