import datetime as dt

from conftest import by_key
from claimgauge.operators.features import (
    all_features,
    provider_features,
    service_category_features,
    tag_service_category,
    temporal_features,
)


def test_categories(make_claims):
    codes = {
        "HCPCS-E0100": "DME", "HCPCS-K0100": "DME", "CPT-70100": "Imaging", "CPT-99201": "E&M", "CPT-27100": "Surgical",
        "CPT-60000": "Surgical", "CPT-80100": "Other", "CPT-98000": "Other", "RX-01000": "Other", "99213": "Other",
        "HCPCS-A1": "Other",
    }
    tagged = tag_service_category(make_claims(*[{"procedure_code": c} for c in codes], {"procedure_code": None}))
    got = {r["procedure_code"]: r["service_category"] for r in tagged.collect()}
    assert got == {**codes, None: None}


def test_providers(five_claims):
    got = by_key(provider_features(five_claims), "provider_id")
    assert got["Q1"]["total_claims"] == 2
    assert got["Q1"]["total_allowed"] == 519.0 and got["Q1"]["avg_allowed"] == 259.5
    assert got["Q1"]["unique_members"] == 2 and got["Q1"]["unique_procedure_codes"] == 2
    assert got["Q1"]["entity_age_days"] == 21
    assert got["Q1"]["specialty"] == "Geriatrics"  # that of the earliest claim
    assert got["Q2"]["denial_rate"] == 1.0 and got["Q2"]["appeal_rate"] == 1.0
    assert got["Q3"]["oon_rate"] == 0.5 and got["Q3"]["dme_rate"] == 0.5
    assert got["Q3"]["cost_per_unit"] == 168.0
    assert got["Q3"]["avg_billed_to_allowed_ratio"] == 642.0 / 504.0


def test_providers_do_not_depend_on_partitioning(five_claims):
    base = sorted(provider_features(five_claims).collect())
    assert sorted(provider_features(five_claims.repartition(7, "claim_id")).collect()) == base


def test_zero_allowed_gives_null_ratio(make_claims):
    row = provider_features(make_claims({"allowed_amount": 0.0})).collect()[0]
    assert row["avg_billed_to_allowed_ratio"] is None and row["cost_per_unit"] == 0.0


def test_sub_cent_amounts_are_kept(make_claims):
    row = provider_features(make_claims({"allowed_amount": 36.792}, {"allowed_amount": 0.001})).collect()[0]
    assert row["total_allowed"] == 36.793


def test_rolling_means_count_rows_not_calendar(make_claims):
    # Weeks with 1, 2, 3, 4 and 5 claims; one week without claims lies in between.
    starts = [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 22), dt.date(2024, 1, 29), dt.date(2024, 2, 5)]
    rows = [{"service_date": day + dt.timedelta(days=6)} for n, day in enumerate(starts, 1) for _ in range(n)]
    got = [r for r in temporal_features(make_claims(*rows)).orderBy("period_start").collect()]
    weekly = [(r["period_start"], r["rolling_4w_claims"]) for r in got if r["period_type"] == "weekly"]
    assert weekly == list(zip(starts, [1.0, 1.5, 2.0, 2.5, 3.5]))
    monthly = [(r["total_claims"], r["rolling_4w_claims"]) for r in got if r["period_type"] == "monthly"]
    assert monthly == [(6, 6.0), (9, 7.5)]


def test_monthly_mean_covers_three_periods(make_claims):
    rows = [{"service_date": dt.date(2024, month, 1)} for month in range(1, 5) for _ in range(month)]
    got = temporal_features(make_claims(*rows)).where("period_type = 'monthly'").orderBy("period_start").collect()
    assert [r["rolling_4w_claims"] for r in got] == [1.0, 1.5, 2.0, 3.0]


def test_service_categories(five_claims):
    got = by_key(service_category_features(five_claims), "service_category")
    assert got["E&M"]["total_claims"] == 2 and got["E&M"]["total_allowed"] == 160.0
    assert got["DME"]["cost_per_unit"] == 204.0


def test_empty_claims(make_claims, five_claims):
    empty = five_claims.limit(0)
    assert {name: df.count() for name, df in all_features(empty).items()} == {
        "claims": 0, "provider": 0, "temporal": 0, "service_category": 0,
    }
