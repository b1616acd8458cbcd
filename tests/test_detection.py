import json

import pytest

from claimgauge.config import DetectionConfig
from claimgauge.operators import detection

COLUMNS = (
    "provider_id STRING, total_claims BIGINT, total_allowed DOUBLE, oon_rate DOUBLE, dme_rate DOUBLE, "
    "unique_procedure_codes BIGINT, specialty STRING, geography_state STRING, entity_age_days BIGINT, "
    "avg_billed_to_allowed_ratio DOUBLE"
)


@pytest.fixture
def make(spark):
    def table(*rows):
        base = {
            "total_claims": 10, "total_allowed": 1000.0, "oon_rate": 0.1, "dme_rate": 0.0, "unique_procedure_codes": 5,
            "specialty": "IM", "geography_state": "PA", "entity_age_days": 365, "avg_billed_to_allowed_ratio": 1.5,
        }
        names = [part.split()[0] for part in COLUMNS.split(", ")]
        full = [{"provider_id": f"P{i}", **base, **row} for i, row in enumerate(rows, 1)]
        return spark.createDataFrame([tuple(row[n] for n in names) for row in full], COLUMNS)

    return table


def ids(flags):
    return sorted(r["entity_id"] for r in flags.collect())


def test_high_volume(make):
    volumes = [31, 28, 30, 29, 33, 27, 30, 32, 240]
    flags = detection.flags_high_volume_provider(make(*[{"total_claims": v} for v in volumes])).collect()
    mean = sum(volumes) / 9
    deviation = (sum((v - mean) ** 2 for v in volumes) / 8) ** 0.5
    assert [f["entity_id"] for f in flags] == ["P9"]
    assert flags[0]["severity"] == "medium" and flags[0]["actual_value"] == 240.0
    values = json.loads(flags[0]["feature_values"])
    z = round((240 - mean) / deviation, 2)
    assert values == {"total_claims": 240, "peer_mean": round(mean, 1), "peer_std": round(deviation, 1), "z_score": z}
    assert flags[0]["description"] == f"Provider P9 has 240 claims (z-score={z}, threshold={mean + 2 * deviation:.0f})"


def test_high_volume_needs_variation(make):
    assert ids(detection.flags_high_volume_provider(make({"total_claims": 10}, {"total_claims": 11}, {}))) == []
    assert ids(detection.flags_high_volume_provider(make({}, {}, {}))) == []
    assert ids(detection.flags_high_volume_provider(make({}))) == []


def test_high_severity_beyond_three_deviations(make):
    flags = detection.flags_high_cost_provider(make(*[{}] * 20, {"total_allowed": 1_234_567.891})).collect()
    assert flags[0]["severity"] == "high"
    assert "has $1,234,567.89 total allowed" in flags[0]["description"]
    assert '"total_allowed":1234567.89' in flags[0]["feature_values"]


def test_new_entities(make):
    established = [{"total_claims": n} for n in range(1, 11)]
    new = [
        {"entity_age_days": 89, "total_claims": 10},
        {"entity_age_days": 89, "total_claims": 9},
        {"entity_age_days": 90, "total_claims": 99},
        {"entity_age_days": None, "total_claims": 99},
    ]
    # Eleven established providers: index round(10 * 0.9) = 9 of 1..10, 99.
    features = make(*established, *new)
    assert ids(detection.flags_new_entity_high_volume(features)) == []
    features = make(*established, {"entity_age_days": 3, "total_claims": 10}, {"entity_age_days": 3, "total_claims": 9})
    # Ten established: index floor(9 * 0.9 + 0.5) = 8, the value 9; it must be exceeded.
    assert ids(detection.flags_new_entity_high_volume(features)) == ["P11"]
    assert ids(detection.flags_new_entity_high_volume(make({"entity_age_days": 5, "total_claims": 99}))) == []


def test_equipment_clusters(make):
    suspicious = {"dme_rate": 0.51, "oon_rate": 0.81, "unique_procedure_codes": 3, "total_claims": 20}
    features = make(
        suspicious,
        {**suspicious, "oon_rate": 0.80},
        {**suspicious, "unique_procedure_codes": 4},
        {**suspicious, "total_claims": 19},
        {**suspicious, "dme_rate": 0.5},
    )
    assert ids(detection.flags_oon_dme_cluster(features)) == ["P1"]
    lenient = DetectionConfig(oon_rate_threshold=0.7)
    assert ids(detection.flags_oon_dme_cluster(features, lenient)) == ["P1", "P2"]


def test_billing_ratios(make):
    ratios = [1.0, 1.0, 1.0, 3.0, 3.01, None, float("inf"), float("nan")]
    features = make(*[{"avg_billed_to_allowed_ratio": r} for r in ratios])
    assert ids(detection.flags_billing_ratio_outlier(features)) == ["P5"]
    zeros = make(*[{"avg_billed_to_allowed_ratio": r} for r in (0.0, 0.0, 5.0)])
    assert ids(detection.flags_billing_ratio_outlier(zeros)) == []


def test_order_and_top(make):
    rows = [{}] * 20 + [{"total_claims": 500, "avg_billed_to_allowed_ratio": 9.0}]
    flags = detection.all_flags(make(*rows))
    assert [(r["severity"], r["rule_name"]) for r in detection.sort_flags(flags).collect()] == [
        ("high", "high_volume_provider"),
        ("medium", "billing_ratio_outlier"),
    ]
    assert detection.top_flags(flags, 1).count() == 1


def test_no_providers(make, spark):
    assert detection.all_flags(make({}).limit(0)).count() == 0
