import datetime as dt

from pyspark.sql import functions as F

from claimgauge.operators.validation import route_valid_rows, validate_claims, validate_issues


def issues(claims):
    return [(r["level"], r["rule"], r["affected_rows"], r["examples"]) for r in validate_issues(claims).collect()]


def critical(claims):
    return [issue[1:] for issue in issues(claims) if issue[0] == "critical"]


def test_sound_claims_pass(five_claims):
    assert critical(five_claims) == []
    row = validate_claims(five_claims).collect()[0]
    assert (row["passed"], row["total_rows"], row["critical_issues"]) == (True, 5, 0)


def test_each_fault(make_claims):
    faults = [
        ({"member_id": None}, ("not_null", 1, [])),
        ({"billed_amount": -100.0}, ("non_negative_amount", 1, [])),
        ({"units": 0}, ("positive_units", 1, [])),
        ({"network_status": "INVALID"}, ("enum_values", 1, ["INVALID"])),
        ({"denial_flag": "Y"}, ("denial_reason_required", 1, [])),
        ({"denial_reason_category": "whim"}, ("denial_reason_enum", 1, [])),
        ({"claim_received_date": dt.date(2024, 1, 1)}, ("date_ordering", 1, [])),
    ]
    for row, expected in faults:
        claims = make_claims(row, {})
        assert critical(claims) == [expected], row
        assert not validate_claims(claims).collect()[0]["passed"]


def test_messages(make_claims):
    claims = make_claims({"member_id": None, "units": 0, "denial_flag": "Y"}, {"member_id": None})
    assert [r["message"] for r in validate_issues(claims).collect() if r["level"] == "critical"] == [
        "Column 'member_id' has 2 null values",
        "Column 'units' has 1 values < 1",
        "1 claims have denial_flag=Y but null denial_reason_category",
    ]


def test_a_null_is_no_unaccepted_value(make_claims):
    assert critical(make_claims({"plan_type": None}, {})) == [("not_null", 1, [])]


def test_five_smallest_examples(make_claims):
    claims = make_claims(*[{"plan_type": name} for name in "hgfedcbab"])
    assert critical(claims) == [("enum_values", 9, list("abcde"))]


def test_zero_variance_needs_two_rows(make_claims):
    def advisory(claims):
        return [rule for level, rule, *_ in issues(claims) if rule == "zero_variance"]

    assert len(advisory(make_claims({}, {}))) == 3
    assert advisory(make_claims({})) == []


def test_high_null_rate_of_any_column(make_claims):
    claims = make_claims({}, {}, {}).withColumn("extra", F.when(F.col("claim_id") == "C1", 1))
    found = {r["message"] for r in validate_issues(claims).collect() if r["rule"] == "high_null_rate"}
    assert found == {"Column 'extra' has 66.7% nulls", "Column 'denial_reason_category' has 100.0% nulls"}


def test_missing_columns_stop_the_check(five_claims):
    claims = five_claims.drop("units", "specialty")
    assert issues(claims) == [("critical", "column_presence", 5, [])]
    assert validate_issues(claims).collect()[0]["message"] == "Missing required columns: ['specialty', 'units']"
    assert not validate_claims(claims).collect()[0]["passed"]


def test_empty_table(five_claims):
    row = validate_claims(five_claims.limit(0)).collect()[0]
    assert (row["passed"], row["total_rows"], row["advisory_issues"]) == (True, 0, 0)


def test_rows_are_routed(make_claims):
    claims = make_claims({"units": 0, "plan_type": None}, {}, {"denial_flag": "Y"})
    got = {r["claim_id"]: r["failed_rules"] for r in route_valid_rows(claims).collect()}
    assert got == {
        "C1": ["not_null:plan_type", "positive_units:units"],
        "C2": [],
        "C3": ["denial_reason_required"],
    }
