"""Policy events, appeals, benchmarks, reconciliation and report tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import by_key
from claimgauge.config import BenchmarkBaseline, DetectionConfig, PolicyChangeEvent
from claimgauge.operators import appeals, benchmarks, policy_events, reconcile, report_tables

JULY = dt.date(2024, 7, 1)


def event(*prefixes, kind="removed", name="POL"):
    return PolicyChangeEvent(name, prefixes, kind, JULY, "text")


@pytest.fixture(scope="module")
def around_july(make_claims):
    days = [dt.date(2024, 5, 1)] * 50 + [dt.date(2024, 8, 1)] * 50
    return make_claims(*[{"service_date": day, "procedure_code": "CPT-70100"} for day in days])


def test_before_and_after(around_july):
    row = policy_events.policy_impact(around_july, [event("CPT-7")]).collect()[0]
    assert (row["pre_volume"], row["post_volume"]) == (50, 50)
    assert row["rebound_detected"]
    assert row["rebound_detail"] == (
        "Post-removal volume (50) is 100% of pre-removal volume (50). Utilization did not decrease as expected."
    )


def test_events_keep_their_order_and_count_claims_once(around_july):
    events = [event("NONE", name="Z"), event("CPT-7", "CPT-70", name="A"), event("CPT-7", kind="added", name="M")]
    rows = policy_events.policy_impact(around_july, events).collect()
    assert [(r["policy_id"], r["pre_volume"], r["rebound_detected"]) for r in rows] == [
        ("Z", 0, False), ("A", 50, True), ("M", 50, False),
    ]
    assert rows[0]["pre_total_allowed"] == 0.0 and rows[0]["rebound_detail"] == ""
    assert policy_events.policy_impact(around_july, []).count() == 0


def test_many_events_equal_brute_force(spark, make_claims):
    rng = random.Random(8)
    codes = ["CPT-70100", "CPT-70", "CPT-99201", "HCPCS-E0101", "RX-1", ""]
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(400))
    claims = [
        {"procedure_code": rng.choice(codes), "service_date": day(), "allowed_amount": rng.randrange(10_000) / 100,
         "denial_flag": rng.choice("YN"), "authorization_required": rng.choice("YN"), "claim_id": f"c{i}"}
        for i in range(400)
    ]
    prefixes = ["CPT-7", "CPT-70", "CPT", "HCPCS-E", "NONE", "", "RX-1", None]
    events = [
        (i, f"P{i}", "", day() if i % 17 else None, rng.sample(prefixes, rng.randrange(4)), rng.choice(["removed", "added"]))
        for i in range(300)
    ]
    table = spark.createDataFrame(events, policy_events.EVENT_COLUMNS).repartition(3)
    frame = make_claims(*claims)

    def covers(event, claim):
        return any(p is not None and claim["procedure_code"].startswith(p) for p in event[4])

    got = policy_events.policy_impact(frame, table).collect()
    assert [r["policy_id"] for r in got] == [e[1] for e in events]
    for row, event in zip(got, events):
        hit = [c for c in claims if event[3] and covers(event, c) and abs((c["service_date"] - event[3]).days + 0.5) < 84]
        for period, own in (("pre", [c for c in hit if c["service_date"] < event[3]]), ("post", [c for c in hit if c["service_date"] >= event[3]])):
            assert row[f"{period}_volume"] == len(own)
            assert row[f"{period}_total_allowed"] == pytest.approx(sum(c["allowed_amount"] for c in own))
            assert row[f"{period}_denial_rate"] == pytest.approx(sum(c["denial_flag"] == "Y" for c in own) / max(1, len(own)))
    lifted = by_key(policy_events.apply_policy_event(frame, table), "claim_id")
    for claim in claims:
        covered = any(e[5] == "removed" and e[3] and covers(e, claim) and claim["service_date"] >= e[3] for e in events)
        assert lifted[claim["claim_id"]]["authorization_required"] == ("N" if covered else claim["authorization_required"])


def test_one_plan_for_any_number_of_events(spark, make_claims):
    claims = make_claims({"procedure_code": "CPT-70100", "service_date": dt.date(2024, 5, 1)})

    def plan(n):
        events = spark.range(n).select(
            F.col("id").alias("position"), F.lit("P").alias("policy_id"), F.lit("").alias("description"),
            F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 300).cast("int")).alias("effective_date"),
            F.array(F.lit("CPT-7")).alias("affected_services"), F.lit("removed").alias("change_type"),
        )
        impact = policy_events.policy_impact(claims, events)
        return impact, len(impact._jdf.queryExecution().analyzed().toString().splitlines())

    few, many = plan(4), plan(20_000)
    assert few[1] == many[1]
    assert many[0].where("pre_volume + post_volume > 0").count() == sum(
        abs((dt.date(2024, 5, 1) - dt.date(2024, 1, 1)).days - i % 300 + 0.5) < 84 for i in range(20_000)
    )


def test_rows_made_from_events_are_not_broadcast(spark, make_claims, tmp_path):
    """The files of the events are small, the rows by week made from them many times as large."""
    claims = make_claims({"procedure_code": "CPT-70100", "service_date": dt.date(2024, 5, 1)})
    rows = [(i, f"P{i}", "", JULY, ["CPT-7", "RX"], "removed") for i in range(500)]
    path = f"{tmp_path}/events"
    spark.createDataFrame(rows, policy_events.EVENT_COLUMNS).write.parquet(path)
    measured = policy_events.events_metrics(claims, spark.read.parquet(path), 12)
    plan = measured._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [prefix" in line]
    assert sum("week" in line or "effective_date" in line for line in joins) == 2
    assert not any("Broadcast" in line for line in joins if "week" in line or "effective_date" in line)
    assert [(r["period"], r["volume"]) for r in measured.select("period", "volume").distinct().collect()] == [("pre", 1)]


def test_windows_are_half_open(make_claims):
    days = [JULY - dt.timedelta(84), JULY - dt.timedelta(85), JULY, JULY + dt.timedelta(83), JULY + dt.timedelta(84)]
    claims = make_claims(*[{"service_date": day} for day in days])
    kept = policy_events.window_filter(claims, JULY, 12)
    assert [(r["service_date"], r["period"]) for r in kept.orderBy("service_date").collect()] == [
        (days[0], "pre"), (days[2], "post"), (days[3], "post"),
    ]
    row = policy_events.policy_impact(claims, [event("CPT-99")]).collect()[0]
    assert (row["pre_volume"], row["post_volume"], row["volume_change_pct"]) == (1, 2, 100.0)


def test_changes(make_claims):
    before = [{"service_date": dt.date(2024, 6, 1), "allowed_amount": 5455.33 / 12, "denial_flag": "Y" if i < 2 else "N"} for i in range(12)]
    after = [{"service_date": dt.date(2024, 8, 1), "allowed_amount": 292821.28 / 15, "denial_flag": "Y" if i < 2 else "N",
              "network_status": "OON" if i < 1 else "INN"} for i in range(15)]
    row = policy_events.policy_impact(make_claims(*before, *after), [event("CPT-99")]).collect()[0]
    assert (row["volume_change_pct"], row["cost_change_pct"]) == (25.0, 5267.62)
    assert (row["denial_rate_change"], row["oon_rate_change"]) == (-0.0333, 0.0667)


def test_rebound_threshold(make_claims):
    def rebound(n_after):
        days = [dt.date(2024, 6, 1)] * 10 + [dt.date(2024, 8, 1)] * n_after
        claims = make_claims(*[{"service_date": day} for day in days])
        return policy_events.policy_impact(claims, [event("CPT-99")], DetectionConfig()).collect()[0]["rebound_detected"]

    assert rebound(8) and not rebound(7)


def test_lifting_authorizations(make_claims):
    claims = make_claims(
        {"authorization_required": "Y", "procedure_code": "CPT-70100", "service_date": JULY},
        {"authorization_required": "Y", "procedure_code": "CPT-70100", "service_date": JULY - dt.timedelta(1)},
        {"authorization_required": "Y", "procedure_code": "CPT-80100", "service_date": JULY},
        {"authorization_required": "Y", "procedure_code": None, "service_date": JULY},
    )
    lifted = by_key(policy_events.apply_policy_event(claims, [event("CPT-7")]), "claim_id")
    assert [lifted[f"C{i}"]["authorization_required"] for i in range(1, 5)] == ["N", "Y", "Y", "Y"]
    unchanged = policy_events.apply_policy_event(claims, [event("CPT-7", kind="added")])
    assert {r["authorization_required"] for r in unchanged.collect()} == {"Y"}


def test_no_prefix_matches_nothing(five_claims):
    assert policy_events.prefix_filter(five_claims, ()).count() == 0


def test_period_metrics_of_nothing(five_claims):
    assert tuple(policy_events.period_metrics(five_claims.limit(0)).collect()[0]) == (0, 0.0, 0.0, 0.0, 0.0)


def test_funnel(five_claims):
    row = appeals.appeals_funnel(five_claims, 420.0).collect()[0]
    assert tuple(row) == (5, 1, 1, 0, 0.2, 1.0, 420.0)


def test_appeals_without_denials(make_claims):
    claims = make_claims({"appeal_flag": "Y"}, {})
    row = appeals.appeals_funnel(claims).collect()[0]
    assert (row["total_appeals"], row["overall_appeal_rate"], row["estimated_admin_cost"]) == (1, 0.0, 350.0)
    assert appeals.denial_categories(claims).count() == 0
    assert appeals.appeals_funnel(claims.limit(0)).collect()[0]["overall_denial_rate"] == 0.0


def test_denied_claims_by_reason_and_provider(make_claims):
    denied = {"denial_flag": "Y"}
    claims = make_claims(
        {**denied, "denial_reason_category": "duplicate", "appeal_flag": "Y", "billed_amount": 1.5},
        {**denied, "denial_reason_category": "coding_error", "billed_amount": 2.25},
        {**denied, "denial_reason_category": None},
        {**denied, "denial_reason_category": None},
        {**denied, "denial_reason_category": "duplicate", "provider_id": "P2"},
        {},
    )
    categories = appeals.denial_categories(claims).collect()
    assert [(r["category"], r["denial_count"], r["appeal_rate"]) for r in categories] == [
        ("duplicate", 2, 0.5), ("coding_error", 1, 0.0),
    ]
    providers = appeals.top_appeal_providers(claims).collect()
    assert [(r["provider_id"], r["total_denials"], r["top_denial_reason"]) for r in providers] == [
        ("P1", 4, "unknown"), ("P2", 1, "duplicate"),
    ]
    assert appeals.top_appeal_providers(claims, 1).count() == 1


def test_benchmarks(make_claims, five_claims):
    metrics = {r["metric_name"]: r["value"] for r in benchmarks.internal_metrics(five_claims).collect()}
    assert metrics == {"denial_rate": 0.2, "oon_rate": 0.2, "cost_per_claim": 572.6}
    baselines = (
        BenchmarkBaseline("oon_rate", 0.05, 0.2),
        BenchmarkBaseline("denial_rate", 0.25, 0.15),
        BenchmarkBaseline("cost_per_claim", 572.6, 0.1),
        BenchmarkBaseline("nobody_knows", 2.0, 0.1),
        BenchmarkBaseline("denial_rate", 0.0, 0.1),
    )
    comparison = benchmarks.benchmark_compare(five_claims, baselines)
    assert [(r["variance"], r["direction"], r["exceeds_threshold"]) for r in comparison.collect()] == [
        (3.0, "above", True), (-0.2, "below", True), (0.0, "within", False), (-1.0, "below", True),
        (0.0, "within", False),
    ]
    assert benchmarks.flagged_count(comparison).collect()[0][0] == 3
    assert {r["value"] for r in benchmarks.internal_metrics(five_claims.limit(0)).collect()} == {0.0}


def test_code_reconciliation(make_claims):
    base = make_claims(*[{"procedure_code": code} for code in ("A", "A", "B", None)])
    later = make_claims(*[{"procedure_code": code} for code in ("B", "C", "D")])
    rows = reconcile.code_reconciliation({"base": base, "later": later}).collect()
    assert [tuple(r) for r in rows] == [("base", 4, 3, 1, 0, 0), ("later", 3, 3, 0, 2, 2)]


def test_concentration_with_ties(make_claims):
    claims = make_claims(*[{"billed_amount": value} for value in (50.0, 10.0, 10.0, 10.0, 5.0, 5.0, 4.0, 3.0, 2.0, 1.0)])
    row = reconcile.concentration_share(claims).collect()[0]
    assert (row["total_claims"], row["top_claims"], row["top_share"]) == (10, 2, 0.6)


def test_histogram(make_claims):
    def bins(*amounts):
        rows = report_tables.report_cost_histogram(make_claims(*[{"allowed_amount": a} for a in amounts])).collect()
        assert [r["bin"] for r in rows] == list(range(1, 101))
        return {r["bin"]: r["claims"] for r in rows if r["claims"]}

    assert bins(0.0, 0.99, 1.0, 99.0, 100.0) == {1: 2, 2: 1, 100: 2}
    assert bins(7.0, 7.0) == {51: 2}


def test_trend_band_uses_the_population_deviation(make_claims):
    starts = [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 8), dt.date(2024, 1, 8)]
    rows = report_tables.report_utilization_trend(make_claims(*[{"service_date": d} for d in starts])).collect()
    assert [r["rolling_4w_claims"] for r in rows] == [1.0, 2.0]
    assert (rows[0]["band_mean"], rows[0]["band_upper"], rows[0]["band_lower"]) == (1.5, 2.5, 0.5)


@pytest.mark.parametrize("odd", [[float("nan")], [float("inf")], [float("inf"), float("-inf")], [1e300, 2.0], []])
def test_sums_of_odd_amounts_are_those_of_doubles(make_claims, odd):
    amounts = [1.25, 2.5, *odd]
    claims = make_claims(*[{"allowed_amount": a} for a in amounts]).repartition(3)
    total = report_tables.report_key_metrics(claims, claims.limit(0)).where("metric = 'total_allowed'").first()["value"]
    assert total == pytest.approx(sum(amounts), nan_ok=True)
