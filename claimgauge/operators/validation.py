"""The two-tier check of a claims table: critical issues fail it, advisory ones only warn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimgauge.schema import ACCEPTED, AMOUNTS, CLAIMS, DENIAL_REASONS, REQUIRED, SPARSE

# Fixed values.
HIGH_NULL_RATE = 0.50
EXAMPLES = 5


def _text(value: str) -> str:
    """An SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _unaccepted(name: str, accepted) -> str:
    """Condition of a value outside the list; null, hence not counted, for a null."""
    return f"{name} NOT IN ({', '.join(map(_text, accepted))})"


def row_checks() -> list[tuple[str, str, str]]:
    """(rule, column or '', condition of a bad row) of every critical row-level check, in order."""
    return [
        *[("not_null", name, f"{name} IS NULL") for name in REQUIRED],
        *[("non_negative_amount", name, f"{name} < 0") for name in AMOUNTS],
        ("positive_units", "units", "units < 1"),
        *[("enum_values", name, _unaccepted(name, accepted)) for name, accepted in ACCEPTED.items()],
        ("denial_reason_required", "", "denial_flag = 'Y' AND denial_reason_category IS NULL"),
        ("denial_reason_enum", "", _unaccepted("denial_reason_category", DENIAL_REASONS)),
        ("date_ordering", "", "claim_received_date < service_date"),
    ]


# Message parts; {name} is the column, {n} the row count, {share} the null rate.
MESSAGES = {
    "not_null": "Column '{name}' has {n} null values",
    "non_negative_amount": "Column '{name}' has {n} negative values",
    "positive_units": "Column 'units' has {n} values < 1",
    "enum_values": "Column '{name}' has {n} rows with invalid values",
    "denial_reason_required": "{n} claims have denial_flag=Y but null denial_reason_category",
    "denial_reason_enum": "{n} claims have invalid denial_reason_category",
    "date_ordering": "{n} claims have claim_received_date before service_date",
    "zero_variance": "Column '{name}' has zero variance — suspicious for real data",
    "high_null_rate": "Column '{name}' has {share} nulls",
}
SHARE = "format_string('%.1f%%', round(100D * {n} / total_rows, 1))"


def _message(rule: str, name: str, n: str) -> str:
    """SQL of the message: the text pieces around the placeholders, concatenated with their values."""
    text = MESSAGES[rule].replace("{name}", name)
    placeholder, value = ("{share}", SHARE.format(n=n)) if "{share}" in text else ("{n}", n)
    return f"concat_ws({value}, {', '.join(map(_text, text.split(placeholder)))})" if placeholder in text else _text(text)


def _missing(claims: DataFrame) -> list[str]:
    return sorted(set(CLAIMS.names) - set(claims.columns))


def _issue(level: str, rule: str, name: str, message: str, n: str, position: int) -> str:
    return (
        f"named_struct('level', '{level}', 'rule', '{rule}', 'column_name', {_text(name)}, 'message', {message}, "
        f"'affected_rows', CAST({n} AS BIGINT), 'position', {position})"
    )


def scan(claims: DataFrame) -> DataFrame:
    """One row, ``total_rows`` and ``issues``, from a single pass over the claims.

    All counters have a fixed width, so the pass is one hash aggregation with map-side sums.
    """
    missing = _missing(claims)
    if missing:
        message = _text(f"Missing required columns: {missing}")
        issue = _issue("critical", "column_presence", "", message, "total_rows", 0)
        return claims.selectExpr("count(*) AS total_rows").selectExpr("total_rows", f"array({issue}) AS issues")

    critical = row_checks()
    nulls = [
        ("high_null_rate", name, f"`{name.replace('`', '``')}` IS NULL")
        for name in claims.columns
        if name not in SPARSE
    ]
    counted = claims.selectExpr(
        "count(*) AS total_rows",
        *[f"count_if({bad}) AS c{i}" for i, (_, _, bad) in enumerate(critical + nulls)],
        *[f"count({name}) > 1 AND min({name}) = max({name}) AS constant_{name}" for name in AMOUNTS],
    )
    found = [(f"c{i} > 0", "critical", rule, name, f"c{i}") for i, (rule, name, _) in enumerate(critical)]
    found += [(f"constant_{name}", "advisory", "zero_variance", name, "total_rows") for name in AMOUNTS]
    found += [
        (f"c{i} > total_rows * {HIGH_NULL_RATE}D", "advisory", rule, name, f"c{i}")
        for i, (rule, name, _) in enumerate(nulls, start=len(critical))
    ]
    issues = [
        f"CASE WHEN {condition} THEN {_issue(level, rule, name, _message(rule, name, n), n, position)} END"
        for position, (condition, level, rule, name, n) in enumerate(found)
    ]
    return counted.selectExpr("total_rows", f"array_compact(array({', '.join(issues)})) AS issues")


def _examples(claims: DataFrame) -> DataFrame:
    """Up to five smallest unaccepted values of each checked column.

    Only claims with such a value are looked at, and reduced to distinct combinations of the checked
    columns; only then does each column get rows of its own. The row number is limited on the map
    side, so a column full of distinct garbage never gathers in one task.
    """
    bad = " ".join(f"WHEN '{name}' THEN {_unaccepted('value', accepted)}" for name, accepted in ACCEPTED.items())
    ranked = (
        claims.select(*ACCEPTED)
        .where(" OR ".join(_unaccepted(name, accepted) for name, accepted in ACCEPTED.items()))
        .distinct()
        .unpivot([], list(ACCEPTED), "column_name", "value")
        .where(f"CASE column_name {bad} END")
        .distinct()
        .withColumn("place", F.row_number().over(Window.partitionBy("column_name").orderBy("value")))
        .where(F.col("place") <= EXAMPLES)
    )
    return ranked.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("examples"))


def validate_issues(claims: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """One row per issue: ``level, rule, message, affected_rows, examples``, in checking order.

    ``scanned`` is the claims' :func:`scan`, if it is there already.
    """
    issues = (scan(claims) if scanned is None else scanned).select(F.explode("issues").alias("issue")).select("issue.*")
    none = F.array().cast("array<string>")
    if _missing(claims):
        return issues.select("level", "rule", "message", "affected_rows", none.alias("examples"))
    examples = _examples(claims).withColumn("rule", F.lit("enum_values"))
    return (
        issues.join(examples, ["rule", "column_name"], "left")
        .orderBy("position")
        .select("level", "rule", "message", "affected_rows", F.coalesce("examples", none).alias("examples"))
    )


def validate_claims(claims: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """One row: ``passed, total_rows, critical_issues, advisory_issues``."""

    def count(level: str) -> Column:
        return F.size(F.filter("issues", lambda issue: issue["level"] == level)).cast("long")

    return (scan(claims) if scanned is None else scanned).select(
        (count("critical") == 0).alias("passed"),
        "total_rows",
        count("critical").alias("critical_issues"),
        count("advisory").alias("advisory_issues"),
    )


def route_valid_rows(claims: DataFrame) -> DataFrame:
    """Add ``failed_rules``, the critical row checks that the row fails; empty for a good row.

    A row-by-row step, so it splits streams as well.
    """
    failed = [
        f"CASE WHEN {bad} THEN '{f'{rule}:{name}' if name else rule}' END" for rule, name, bad in row_checks()
    ]
    return claims.withColumn("failed_rules", F.expr(f"array_compact(array({', '.join(failed)}))"))
