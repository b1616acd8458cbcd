"""SQL for every query, to be run by DuckDB on the driver tables.

Shared steps are common table expressions; ``sql`` puts the ones a statement names in front of it.
"""

from __future__ import annotations

from catalog.fixed_values import (
    ACCEPTED,
    AMOUNTS,
    COLUMNS,
    DENIAL_REASONS,
    POLICY_DOCUMENT,
    REQUIRED,
    SERVICE_CATEGORIES,
    SPARSE,
)

STEPS: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLE: dict[str, str] = {}


def step(name: str, needs: str, text: str) -> None:
    STEPS[name] = (tuple(needs.split()), text)


def sql(needs: str, text: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in STEPS[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS ({STEPS[name][1]})" for name in ordered) + "\n" + text


def check(name: str, needs: str, text: str) -> None:
    ORACLE[name] = sql(needs, text)


def money(amount: str) -> str:
    return f"COALESCE(CAST(sum(CAST({amount} AS DECIMAL(18,2))) AS DOUBLE), 0)"


def share(condition: str) -> str:
    return f"(count(*) FILTER (WHERE {condition})) / count(*)"


def cases(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in pairs) + f" ELSE {otherwise} END"


# Claims derived from the order tables

step("b", "", """
  SELECT l.*, o.o_custkey, c.c_mktsegment,
    (l_orderkey*131 + l_linenumber*17 + l_partkey*7  + l_suppkey)   % 1000 AS u1,
    (l_orderkey*37  + l_linenumber*101 + l_partkey*13 + l_suppkey*3) % 1009 AS u2,
    (l_orderkey*59  + l_linenumber + l_partkey*29 + l_suppkey*5)     % 997  AS u3,
    CASE WHEN l_partkey % 10 = 0 THEN l_suppkey - l_suppkey % 20 ELSE l_suppkey END AS prov
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey""")
step("k", "b", """
  SELECT *, prov % 20 = 0 AS clu, (prov % 20 <> 0 AND u3 % 100 < 12) AS den,
    CASE WHEN prov % 20 = 0 OR u1 % 100 < 60 THEN 'Professional'
         WHEN u1 % 100 < 85 THEN 'Institutional' ELSE 'Pharmacy' END AS claim_type,
    CASE WHEN prov % 20 = 0 THEN date '2001-08-01' + CAST(u1 % 60 AS INT) ELSE CAST(l_shipdate AS DATE) END AS service_date,
    floor(l_extendedprice * (CASE WHEN prov % 20 = 7 THEN 5 ELSE 40 + u1 % 56 END)) / 100 AS allowed_amount,
    CASE u2 % 6 WHEN 0 THEN 'medical_necessity' WHEN 1 THEN 'not_covered' WHEN 2 THEN 'authorization_missing'
                WHEN 3 THEN 'coding_error' WHEN 4 THEN 'duplicate' ELSE 'untimely_filing' END AS rsn,
    CASE u2 % 6 WHEN 0 THEN 40 WHEN 1 THEN 15 WHEN 2 THEN 30 WHEN 3 THEN 10 WHEN 4 THEN 5 ELSE 2 END AS prop
  FROM b""")
step("claims", "k", """
SELECT concat('CLM-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS claim_id,
  concat('MEM-', o_custkey) AS member_id,
  concat('PROV-', prov) AS provider_id,
  CASE WHEN u2 % 10 < 3 THEN NULL ELSE concat('FAC-', prov % 20) END AS facility_id,
  CASE WHEN u2 % 20 < 9 THEN 'Commercial' WHEN u2 % 20 < 14 THEN 'Medicare' WHEN u2 % 20 < 18 THEN 'Medicaid' ELSE 'Exchange' END AS payer_product,
  CASE u3 % 4 WHEN 0 THEN 'HMO' WHEN 1 THEN 'PPO' WHEN 2 THEN 'POS' ELSE 'EPO' END AS plan_type,
  CASE WHEN u2 % 20 < 9 THEN 'Group' WHEN u2 % 20 < 14 THEN 'Medicare' WHEN u2 % 20 < 18 THEN 'Medicaid' ELSE 'Individual' END AS line_of_business,
  service_date, service_date + CAST(1 + u2 % 30 AS INT) AS claim_received_date,
  CASE WHEN u3 % 20 = 0 THEN NULL ELSE service_date + CAST(15 + u2 % 30 + u1 % 77 AS INT) END AS paid_date,
  claim_type, CASE WHEN clu THEN '12' WHEN u1 % 3 = 0 THEN '11' WHEN u1 % 3 = 1 THEN '21' ELSE '23' END AS place_of_service,
  CASE WHEN u3 % 3 = 0 THEN concat('["DX-', 1000 + u2 % 7, '"]')
       ELSE concat('["DX-', 1000 + u2 % 7, '", "DX-', 2000 + u1 % 11, '"]') END AS diagnosis_codes,
  CASE WHEN clu THEN concat('HCPCS-E010', u1 % 2)
       WHEN claim_type = 'Pharmacy' THEN concat('RX-0', 1000 + l_partkey % 5)
       WHEN u2 % 100 < 35 THEN concat('CPT-99', 201 + l_partkey % 5)
       WHEN u2 % 100 < 55 THEN concat('CPT-70', 100 + l_partkey % 5)
       WHEN u2 % 100 < 70 THEN concat('CPT-', 2 + l_partkey % 5, '100')
       WHEN u2 % 100 < 80 THEN concat('HCPCS-E0', 110 + l_partkey % 10)
       ELSE concat('CPT-80', 100 + l_partkey % 5) END AS procedure_code,
  CASE WHEN claim_type = 'Institutional' THEN concat('0', 100 + u3 % 800) END AS revenue_code,
  l_extendedprice AS billed_amount, allowed_amount,
  CASE WHEN den THEN 0.0 ELSE floor(allowed_amount * 90) / 100 END AS paid_amount,
  CAST(l_quantity AS BIGINT) AS units,
  CASE WHEN (clu AND u3 % 100 < 95) OR (NOT clu AND u3 % 10 = 3) THEN 'OON' ELSE 'INN' END AS network_status,
  CASE WHEN NOT clu AND u2 % 4 = 1 THEN 'Y' ELSE 'N' END AS authorization_required,
  CASE WHEN NOT clu AND u2 % 4 = 1 AND u1 % 10 > 0 THEN concat('AUTH-', u1) END AS authorization_id,
  CASE WHEN den THEN 'Y' ELSE 'N' END AS denial_flag,
  CASE WHEN den THEN rsn END AS denial_reason_category,
  CASE WHEN den AND u1 % 100 < prop THEN 'Y' ELSE 'N' END AS appeal_flag,
  CASE WHEN u2 % 50 = 7 THEN 'Y' ELSE 'N' END AS grievance_flag,
  CASE WHEN clu OR (claim_type <> 'Pharmacy' AND u2 % 100 BETWEEN 70 AND 79) THEN 'Y' ELSE 'N' END AS dme_flag,
  CASE WHEN clu THEN 'DME Supplier' END AS supplier_type,
  concat('NPI', prov) AS rendering_npi, concat('NPI', prov) AS billing_npi,
  CASE prov % 4 WHEN 0 THEN 'PA' WHEN 1 THEN 'FL' WHEN 2 THEN 'OH' ELSE 'CA' END AS geography_state,
  CASE prov % 4 WHEN 0 THEN 'Northeast' WHEN 1 THEN 'Southeast' WHEN 2 THEN 'Midwest' ELSE 'West' END AS geography_region,
  CASE WHEN clu THEN 'DME Supplier' WHEN prov % 3 = 0 THEN 'Radiology' WHEN prov % 3 = 1 THEN 'Cardiology' ELSE 'Orthopedics' END AS specialty
FROM k""")

CATEGORY = cases(
    [("procedure_code IS NULL", "NULL")]
    + [(f"starts_with(procedure_code, '{prefix}')", f"'{name}'") for prefix, name in SERVICE_CATEGORIES.items()],
    "'Other'",
)
step("tagged", "claims", f"SELECT *, {CATEGORY} AS service_category FROM claims")

step(
    "faulty",
    "claims",
    """
SELECT * REPLACE (
    CASE WHEN grievance_flag = 'Y' AND denial_flag = 'Y' THEN NULL ELSE member_id END AS member_id,
    CASE WHEN denial_reason_category = 'duplicate' THEN -billed_amount ELSE billed_amount END AS billed_amount,
    CASE WHEN units = 1 THEN 0 ELSE units END AS units,
    CASE WHEN plan_type = 'EPO' THEN lower(network_status) ELSE network_status END AS network_status,
    CASE WHEN authorization_required = 'Y' AND authorization_id IS NULL THEN concat('Plan ', provider_id)
         ELSE payer_product END AS payer_product,
    CASE WHEN denial_flag = 'Y' AND place_of_service = '23' THEN NULL
         WHEN denial_reason_category = 'coding_error' THEN 'typing_error'
         ELSE denial_reason_category END AS denial_reason_category,
    CASE WHEN denial_flag = 'Y' AND claim_type = 'Pharmacy' THEN service_date - 1 ELSE claim_received_date END
        AS claim_received_date)
FROM claims""",
)

step(
    "external",
    "claims",
    """
SELECT claim_id, member_id, provider_id, billed_amount AS amount,
    CASE WHEN paid_date IS NOT NULL THEN service_date END AS claim_date,
    CASE WHEN grievance_flag = 'Y' THEN 'UNKNOWN' WHEN plan_type <> 'EPO'
         THEN regexp_extract(diagnosis_codes, 'DX-[0-9]+') END AS diagnosis,
    procedure_code, specialty, claim_type, denial_flag = 'Y' AS denied
FROM claims""",
)
ADAPTED = {
    "claim_id": "claim_id",
    "member_id": "member_id",
    "provider_id": "provider_id",
    "facility_id": "CAST(NULL AS VARCHAR)",
    "payer_product": "'Commercial'",
    "plan_type": "'PPO'",
    "line_of_business": "'Group'",
    "service_date": "claim_date",
    "claim_received_date": "claim_date",
    "paid_date": "CASE WHEN NOT denied THEN claim_date + 30 END",
    "claim_type": "claim_type",
    "place_of_service": "'11'",
    "diagnosis_codes": "CASE WHEN diagnosis IS NOT NULL THEN concat('[\"', diagnosis, '\"]') END",
    "procedure_code": "procedure_code",
    "revenue_code": "CAST(NULL AS VARCHAR)",
    "billed_amount": "amount",
    "allowed_amount": "amount * CAST(0.8 AS DOUBLE)",
    "paid_amount": "CASE WHEN denied THEN CAST(0 AS DOUBLE) ELSE amount * CAST(0.7 AS DOUBLE) END",
    "units": "CAST(1 AS BIGINT)",
    "network_status": "'INN'",
    "authorization_required": "'N'",
    "authorization_id": "CAST(NULL AS VARCHAR)",
    "denial_flag": "CASE WHEN denied THEN 'Y' ELSE 'N' END",
    "denial_reason_category": "CASE WHEN denied THEN 'medical_necessity' END",
    "appeal_flag": "'N'",
    "grievance_flag": "'N'",
    "dme_flag": "'N'",
    "supplier_type": "CAST(NULL AS VARCHAR)",
    "rendering_npi": "provider_id",
    "billing_npi": "provider_id",
    "geography_state": "'PA'",
    "geography_region": "'Northeast'",
    "specialty": "specialty",
}


def adapted(names) -> str:
    return "SELECT " + ", ".join(f"{ADAPTED[name]} AS {name}" for name in names) + " FROM external"


# Features

step(
    "providers",
    "claims",
    f"""
SELECT *, last_claim_date - first_claim_date AS entity_age_days,
    total_billed / nullif(total_allowed, 0) AS avg_billed_to_allowed_ratio,
    total_allowed / nullif(total_units, 0) AS cost_per_unit
FROM (
SELECT provider_id, count(*) AS total_claims, {money("allowed_amount")} AS total_allowed,
    {money("allowed_amount")} / count(allowed_amount) AS avg_allowed,
    {money("billed_amount")} AS total_billed,
    CAST(sum(units) AS BIGINT) / count(units) AS avg_units, CAST(sum(units) AS BIGINT) AS total_units,
    {share("network_status = 'OON'")} AS oon_rate, {share("denial_flag = 'Y'")} AS denial_rate,
    {share("appeal_flag = 'Y'")} AS appeal_rate, {share("dme_flag = 'Y'")} AS dme_rate,
    min(service_date) AS first_claim_date, max(service_date) AS last_claim_date,
    count(DISTINCT member_id) AS unique_members, count(DISTINCT procedure_code) AS unique_procedure_codes,
    arg_min(specialty, service_date) AS specialty, arg_min(geography_state, service_date) AS geography_state,
    arg_min(geography_region, service_date) AS geography_region
FROM claims GROUP BY provider_id)""",
)
PERIOD = f"""count(*) AS total_claims, {money("allowed_amount")} AS total_allowed,
    {money("billed_amount")} AS total_billed, count(*) FILTER (WHERE denial_flag = 'Y') AS denial_count,
    count(*) FILTER (WHERE network_status = 'OON') AS oon_count"""
for kind, unit in (("weekly", "week"), ("monthly", "month")):
    step(
        kind,
        "claims",
        f"""
SELECT CAST(date_trunc('{unit}', service_date) AS DATE) AS period_start, {PERIOD}, '{kind}' AS period_type
FROM claims GROUP BY 1""",
    )
ROLLING = """
SELECT *, avg(total_claims) OVER (ORDER BY period_start ROWS BETWEEN {before} PRECEDING AND CURRENT ROW)
    AS rolling_4w_claims FROM {kind}"""
step("temporal", "weekly monthly", ROLLING.format(before=3, kind="weekly") + " UNION ALL " + ROLLING.format(before=2, kind="monthly"))

check("provider_features", "providers", "SELECT * FROM providers")
check(
    "service_category_features",
    "tagged",
    f"""
SELECT service_category, count(*) AS total_claims, {money("allowed_amount")} AS total_allowed,
    {money("allowed_amount")} / count(*) AS avg_allowed, {money("billed_amount")} AS total_billed,
    {share("denial_flag = 'Y'")} AS denial_rate, {share("network_status = 'OON'")} AS oon_rate,
    CAST(sum(units) AS BIGINT) AS total_units, {money("allowed_amount")} / sum(units) AS cost_per_unit
FROM tagged GROUP BY 1""",
)
check("temporal_weekly", "weekly", "SELECT * FROM weekly")
check("temporal_monthly", "monthly", "SELECT * FROM monthly")
check("temporal_features", "temporal", "SELECT * FROM temporal")
check("rolling_claims", "temporal", "SELECT period_type, period_start, rolling_4w_claims FROM temporal")

# Sources and sinks

check("load_claims", "claims", "SELECT * FROM claims")
check("load_external_csv", "external", adapted(COLUMNS))
check(
    "adapt_external_claims",
    "external",
    adapted(
        "claim_id service_date paid_date claim_type diagnosis_codes allowed_amount paid_amount denial_flag "
        "denial_reason_category".split()
    ),
)
check(
    "write_features",
    "providers temporal tagged",
    """
SELECT 'claims' AS feature_set, count(*) AS n_rows FROM tagged
UNION ALL SELECT 'provider', count(*) FROM providers
UNION ALL SELECT 'temporal', count(*) FROM temporal
UNION ALL SELECT 'service_category', count(DISTINCT service_category) FROM tagged""",
)

# Projections and filters

check("tag_service_category", "tagged", "SELECT claim_id, procedure_code, service_category FROM tagged")
LIFTED = """
SELECT * REPLACE (CASE WHEN authorization_required = 'Y' AND (
        (starts_with(procedure_code, 'CPT-7') AND service_date >= DATE '1999-07-01')
        OR ((starts_with(procedure_code, 'HCPCS-E') OR starts_with(procedure_code, 'CPT-99'))
            AND service_date >= DATE '2001-08-15'))
    THEN 'N' ELSE authorization_required END AS authorization_required)
FROM claims"""
step("lifted", "claims", LIFTED)
check("apply_policy_event", "lifted", "SELECT claim_id, procedure_code, service_date, authorization_required FROM lifted")
check(
    "append_claims",
    "lifted",
    """
SELECT claim_id, provider_id, procedure_code, service_date, allowed_amount, authorization_required
FROM (SELECT * FROM claims UNION ALL SELECT * FROM lifted)""",
)
PREFIXES = "['CPT-7', 'CPT-70102', 'HCPCS-E', 'CPT-99', 'CPT', 'RX-0100', 'CPT-80101', 'NONE']"
step(
    "many_events",
    "",
    f"""
SELECT p_partkey AS position, 'EV-' || p_partkey AS policy_id, 'Derived event' AS description,
    DATE '1995-01-01' + CAST(p_partkey * 37 % 2500 AS INT) AS effective,
    CASE WHEN p_partkey % 3 = 0 THEN [{PREFIXES}[p_partkey % 8 + 1], {PREFIXES}[p_partkey // 7 % 8 + 1]]
         ELSE [{PREFIXES}[p_partkey % 8 + 1]] END AS prefixes,
    CASE WHEN p_partkey % 4 = 0 THEN 'added' ELSE 'removed' END AS change_type
FROM part""",
)
check(
    "apply_events_from_table",
    "claims many_events",
    """
SELECT claim_id, claims.procedure_code, service_date,
    CASE WHEN authorization_required = 'Y' AND service_date >= lifted_from THEN 'N' ELSE authorization_required END AS authorization_required
FROM claims LEFT JOIN (
    SELECT procedure_code, min(effective) AS lifted_from FROM (SELECT DISTINCT procedure_code FROM claims)
    JOIN (SELECT unnest(prefixes) AS prefix, effective FROM many_events WHERE change_type = 'removed' AND effective >= DATE '1999-06-01')
        ON starts_with(procedure_code, prefix)
    GROUP BY procedure_code) AS first ON claims.procedure_code = first.procedure_code""",
)
check(
    "prefix_filter",
    "claims",
    "SELECT claim_id, procedure_code FROM claims WHERE procedure_code LIKE 'CPT-7%' OR procedure_code LIKE 'HCPCS-E%'",
)
check(
    "window_filter",
    "claims",
    """
SELECT claim_id, service_date, CASE WHEN service_date < DATE '1999-07-01' THEN 'pre' ELSE 'post' END AS period
FROM claims WHERE service_date >= DATE '1999-07-01' - 84 AND service_date < DATE '1999-07-01' + 84""",
)
check(
    "derive_dates_ages",
    "claims",
    """
SELECT member_id, min(service_date) AS first_claim_date, max(service_date) AS last_claim_date,
    max(service_date) - min(service_date) AS entity_age_days
FROM claims GROUP BY 1""",
)
check(
    "derive_ratios",
    "claims",
    """
SELECT claim_id, billed_amount AS total_billed, paid_amount AS total_allowed, units AS total_units,
    CASE WHEN paid_amount <> 0 THEN billed_amount / paid_amount END AS avg_billed_to_allowed_ratio,
    paid_amount / units AS cost_per_unit
FROM claims""",
)
check(
    "is_finite_filter",
    "claims",
    "SELECT claim_id, billed_amount / paid_amount AS ratio FROM claims WHERE paid_amount <> 0",
)

# Validation


def quoted(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


CHECKS: list[tuple[str, str, str, str]] = [
    *[("not_null", c, f"{c} IS NULL", f"'Column ''{c}'' has ' || n || ' null values'") for c in REQUIRED],
    *[("non_negative_amount", c, f"{c} < 0", f"'Column ''{c}'' has ' || n || ' negative values'") for c in AMOUNTS],
    ("positive_units", "units", "units < 1", "'Column ''units'' has ' || n || ' values < 1'"),
    *[
        ("enum_values", c, f"{c} NOT IN ({quoted(ok)})", f"'Column ''{c}'' has ' || n || ' rows with invalid values'")
        for c, ok in ACCEPTED.items()
    ],
    (
        "denial_reason_required", "", "denial_flag = 'Y' AND denial_reason_category IS NULL",
        "n || ' claims have denial_flag=Y but null denial_reason_category'",
    ),
    (
        "denial_reason_enum", "", f"denial_reason_category NOT IN ({quoted(DENIAL_REASONS)})",
        "n || ' claims have invalid denial_reason_category'",
    ),
    (
        "date_ordering", "", "claim_received_date < service_date",
        "n || ' claims have claim_received_date before service_date'",
    ),
]


def issue_rows(table: str) -> str:
    rows = []
    for rule, column, bad, message in CHECKS:
        examples = (
            f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {column} AS v FROM {table} WHERE {bad} ORDER BY 1 LIMIT 5))"
            if rule == "enum_values"
            else "NULL"
        )
        rows.append(
            f"SELECT 'critical' AS level, '{rule}' AS rule, {message} AS message, n AS affected_rows, "
            f"COALESCE({examples}, '') AS examples FROM (SELECT count(*) AS n FROM {table} WHERE {bad}) WHERE n > 0"
        )
    for column in AMOUNTS:
        rows.append(
            f"SELECT 'advisory', 'zero_variance', 'Column ''{column}'' has zero variance — suspicious for real data', "
            f"n, '' FROM (SELECT count(*) AS n, var_samp({column}) AS v FROM {table}) WHERE v = 0"
        )
    for column in COLUMNS:
        if column not in SPARSE:
            rows.append(
                f"SELECT 'advisory', 'high_null_rate', 'Column ''{column}'' has ' || "
                f"printf('%.1f', round(100.0 * n / total, 1)) || '% nulls', n, '' FROM "
                f"(SELECT count(*) FILTER (WHERE {column} IS NULL) AS n, count(*) AS total FROM {table}) WHERE n > 0.5 * total"
            )
    return " UNION ALL ".join(rows)


check("validate_issues", "faulty", issue_rows("faulty"))
check(
    "column_presence",
    "claims",
    """
SELECT 'critical' AS level, 'column_presence' AS rule, 'Missing required columns: [''facility_id'', ''supplier_type'']' AS message,
    count(*) AS affected_rows, '' AS examples FROM claims""",
)
check(
    "zero_variance",
    "claims",
    """
SELECT 'advisory' AS level, 'zero_variance' AS rule, 'Column ''paid_amount'' has zero variance — suspicious for real data' AS message,
    count(*) AS affected_rows, '' AS examples FROM claims
UNION ALL
SELECT 'advisory', 'high_null_rate', 'Column ''note'' has ' || printf('%.1f', round(100.0 * n / total, 1)) || '% nulls', n, ''
FROM (SELECT count(*) FILTER (WHERE claim_type IS DISTINCT FROM 'Pharmacy') AS n, count(*) AS total FROM claims)
WHERE n > total * 0.5""",
)
check(
    "validate_claims",
    "claims",
    f"""
SELECT count(*) FILTER (WHERE level = 'critical') = 0 AS passed, (SELECT count(*) FROM claims) AS total_rows,
    count(*) FILTER (WHERE level = 'critical') AS critical_issues,
    count(*) FILTER (WHERE level = 'advisory') AS advisory_issues
FROM ({issue_rows("claims")})""",
)
check(
    "route_valid_rows",
    "faulty",
    "SELECT claim_id, concat_ws('|', "
    + ", ".join(f"CASE WHEN {bad} THEN '{f'{rule}:{column}' if column else rule}' END" for rule, column, bad, _ in CHECKS)
    + ") AS failed_rules FROM faulty",
)

# Quantiles and top codes



def nearest(column: str, rank: str, q: float) -> str:
    return f"max(CASE WHEN {rank} = CAST(floor((n - 1) * CAST({q} AS DOUBLE) + 0.5) AS BIGINT) + 1 THEN {column} END)"


check(
    "nearest_quantile",
    "claims",
    f"""
SELECT claim_type, specialty, {nearest("allowed_amount", "r", 0.1)} AS p10, {nearest("allowed_amount", "r", 0.5)} AS p50,
    {nearest("allowed_amount", "r", 0.9)} AS p90
FROM (SELECT *, row_number() OVER (PARTITION BY claim_type, specialty ORDER BY allowed_amount) AS r,
        count(*) OVER (PARTITION BY claim_type, specialty) AS n FROM claims)
GROUP BY 1, 2""",
)
check(
    "continuous_quantile",
    "claims",
    f"""
SELECT kind, {nearest("v", "r", 0.1)} AS p10, {nearest("v", "r", 0.5)} AS p50, {nearest("v", "r", 0.99)} AS p99
FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY v) AS r, count(*) OVER (PARTITION BY kind) AS n
      FROM (SELECT 'ratio' AS kind, CAST(billed_amount AS DOUBLE) / CAST(allowed_amount AS DOUBLE) AS v FROM claims WHERE allowed_amount > 0
            UNION ALL
            SELECT 'close', CAST(1000 AS DOUBLE) + CAST(billed_amount AS DOUBLE) / CAST(allowed_amount AS DOUBLE) / CAST(1e6 AS DOUBLE)
            FROM claims WHERE allowed_amount > 0))
GROUP BY kind""",
)
check("exact_median", "claims", "SELECT provider_id, median(billed_amount) AS median_billed FROM claims GROUP BY 1")


def code_json(entries: str) -> str:
    """Text like [{"code":"A","count":1}] from rows of code and n."""
    return f"""'[' || COALESCE(string_agg('{{"code":"' || code || '","count":' || n || '}}', ',' ORDER BY {entries}), '') || ']'"""


def top(table: str, keys: str, k: int) -> str:
    return f"""
SELECT {keys}, code, n, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, code) AS place
FROM (SELECT {keys}, code, count(*) AS n
      FROM (SELECT {keys}, unnest(regexp_extract_all(diagnosis_codes, 'DX-[0-9]+')) AS code FROM {table})
      GROUP BY ALL)
QUALIFY place <= {k}"""


check(
    "top_k_codes",
    "claims",
    f"SELECT specialty, claim_type, {code_json('place')} AS top_diagnosis_codes FROM ({top('claims', 'specialty, claim_type', 4)}) GROUP BY 1, 2",
)

# Policy seeds, documents and rules

CLUSTER = "procedure_code, claim_type, specialty"


def clusters(min_claims: int) -> str:
    return f"""
SELECT {CLUSTER}, count(*) AS n_claims, {share("denial_flag = 'N'")} AS approval_rate,
    {share("denial_flag = 'Y'")} AS denial_rate, {money("allowed_amount")} / count(*) AS avg_claim_amount,
    {nearest("allowed_amount", "r", 0.5)} AS p50_claim_amount, {nearest("allowed_amount", "r", 0.9)} AS p90_claim_amount
FROM (SELECT *, row_number() OVER (PARTITION BY {CLUSTER} ORDER BY allowed_amount) AS r,
        count(*) OVER (PARTITION BY {CLUSTER}) AS n FROM claims)
GROUP BY {CLUSTER} HAVING count(*) >= {min_claims}"""


step("clusters", "claims", clusters(30))
step("cluster_codes", "claims", top("claims", CLUSTER, 5))
step(
    "seeds",
    "clusters cluster_codes",
    f"""
SELECT s.*, c.top_diagnosis_codes, c.codes,
    'POL_' || concat_ws('_', trim(regexp_replace(s.procedure_code, '[^A-Za-z0-9]+', '_', 'g'), '_'),
        trim(regexp_replace(s.claim_type, '[^A-Za-z0-9]+', '_', 'g'), '_'),
        trim(regexp_replace(s.specialty, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS stem
FROM clusters s LEFT JOIN (
    SELECT {CLUSTER}, {code_json('place')} AS top_diagnosis_codes, list(code ORDER BY place) AS codes
    FROM cluster_codes GROUP BY {CLUSTER}) c USING ({CLUSTER})""",
)
check("policy_seeds", "seeds", "SELECT * EXCLUDE (stem, codes) FROM seeds")
check(
    "sort_seeds",
    "claims",
    f"SELECT {CLUSTER}, n_claims, p50_claim_amount FROM ({clusters(1)})",
)
check(
    "write_policy_seeds",
    "seeds",
    "SELECT * EXCLUDE (stem, codes) FROM seeds, (VALUES ('parquet'), ('jsonl')) AS kinds(kind)",
)


def document() -> str:
    """The document layout with an SQL expression in every place of a value."""
    code, site, specialty = CLUSTER.split(", ")
    pct = "printf('%.1f', round({0} * 100, 1))"
    criteria = (
        "concat_ws(chr(10), '- Requires documentation of Dx in [' || array_to_string(codes, ', ') || '].', "
        f"CASE WHEN denial_rate > 0 THEN '- Prior authorization required; historical denial rate is ' || {pct.format('denial_rate')} || '%.' END, "
        "CASE WHEN approval_rate >= 0.9 THEN '- Service is routinely approved when clinical criteria are met.' END, "
        "'- Medical necessity must be established by the treating provider.')"
    )
    diagnoses = "'  - ' || array_to_string(codes, chr(10) || '  - ')"
    values = [
        code, specialty, site, code, specialty, site, criteria, code, grouped("n_claims", 0), diagnoses,
        *[grouped(name, 2) for name in ("avg_claim_amount", "p50_claim_amount", "p90_claim_amount")],
        pct.format("approval_rate"), pct.format("denial_rate"),
    ]
    pieces = POLICY_DOCUMENT.replace("%%", "\0").split("%s")
    literals = ["'" + piece.replace("\0", "%").replace("'", "''") + "'" for piece in pieces]
    return " || ".join([literals[0]] + [f"({value}) || {literal}" for value, literal in zip(values, literals[1:])])


def grouped(value: str, places: int) -> str:
    """1234.5 as 1,234.50."""
    text = f"printf('%.{places}f', CAST(round({value}, {places}) AS DOUBLE))"
    whole = f"split_part({text}, '.', 1)"
    commas = f"reverse(regexp_replace(reverse({whole}), '([0-9]{{3}})', '\\1,', 'g'))"
    trimmed = f"ltrim({commas}, ',')"
    return f"({trimmed} || '.' || split_part({text}, '.', 2))" if places else trimmed


step("docs", "seeds", f"SELECT stem || '.md' AS file_name, {document()} AS md FROM seeds")
step(
    "rules",
    "docs",
    r"""
SELECT regexp_replace(file_name, '\.md$', '') AS policy_id,
    list_filter(tokens, lambda x, i: list_position(tokens, x) = i) AS covered,
    regexp_extract(md, '\*\*Site of Service \(ClaimType\):\*\* (\w+)', 1) AS site,
    list_filter(regexp_extract_all(regexp_extract(md, '(?s)## 3\. Diagnosis Context(.*?)## 4\.', 1), '- ([^\n]+)\n', 1),
        lambda x: x <> '--') AS dx,
    regexp_extract_all(regexp_extract(md, '(?s)## 4\. Documentation Requirements(.*?)## 5\.', 1), '\n- ([^\n]+)', 1) AS requirements,
    file_name
FROM (SELECT *, regexp_extract_all(md, '\bCPT-\w+\b|\b[0-9]{4,5}[A-Z]?\b') AS tokens FROM docs)""",
)
check("render_policy_docs", "docs", "SELECT * FROM docs")
check("write_policy_docs", "docs", "SELECT file_name, md FROM docs")
for name in ("parse_policy_docs", "parse_policy_files", "load_policy_rules"):
    check(
        name,
        "rules",
        """
SELECT policy_id, array_to_string(covered, '|') AS covered_cpt_codes, site AS site_of_service,
    array_to_string(dx, '|') AS diagnosis_constraints, array_to_string(requirements, '|') AS documentation_requirements,
    file_name AS source_file
FROM rules""",
    )
check(
    "roundtrip_check",
    "rules seeds",
    f"""
SELECT {CLUSTER}, list_contains(covered, procedure_code) AS code_found, site = claim_type AS site_equal,
    list_has_all(dx, codes) AS diagnoses_found
FROM seeds JOIN rules ON stem = policy_id""",
)

# Matching and KPIs

SCORE = """CASE WHEN list_contains(covered, procedure_code) THEN 6 ELSE 0 END
    + CASE WHEN site = claim_type THEN 2 ELSE 0 END
    + CASE WHEN list_has_any(dx, regexp_extract_all(diagnosis_codes, 'DX-[0-9]+')) THEN 2 ELSE 0 END"""
step("combos", "claims", "SELECT DISTINCT procedure_code, claim_type, diagnosis_codes FROM claims")
step(
    "assigned",
    "combos rules",
    f"""
SELECT procedure_code, claim_type, diagnosis_codes, CASE WHEN score > 0 THEN policy_id ELSE 'unmatched' END AS policy_id,
    COALESCE(score, 0) / 10 AS match_confidence
FROM (SELECT *, {SCORE} AS score FROM combos LEFT JOIN rules ON true)
QUALIFY row_number() OVER (PARTITION BY procedure_code, claim_type, diagnosis_codes ORDER BY score DESC, file_name) = 1""",
)
step("matched", "claims assigned", "SELECT * FROM claims JOIN assigned USING (procedure_code, claim_type, diagnosis_codes)")
for name in ("match_claims_to_policies", "match_claims_by_join"):
    check(name, "matched", "SELECT claim_id, procedure_code, policy_id, match_confidence FROM matched")
check(
    "match_score",
    "claims rules seeds",
    f"""
SELECT claim_id, policy_id, ({SCORE}) / 10 AS match_confidence
FROM claims JOIN seeds USING ({CLUSTER}) JOIN rules ON stem = policy_id""",
)
step("policy_codes", "matched", top("matched", "policy_id", 5))
step(
    "policy_specialties",
    "matched",
    """
SELECT policy_id, specialty, row_number() OVER (PARTITION BY policy_id ORDER BY count(*) DESC, specialty) AS place
FROM matched GROUP BY 1, 2 QUALIFY place <= 5""",
)
AMOUNT = "COALESCE(nullif(allowed_amount, 0), nullif(billed_amount, 0), 0)"
step(
    "kpis",
    "matched policy_codes policy_specialties",
    f"""
SELECT policy_id, count(*) AS n_claims, round({money(AMOUNT)}, 2) AS total_amount,
    round({money(AMOUNT)} / count(*), 2) AS avg_amount, round({share("denial_flag <> 'Y'")}, 4) AS approval_rate,
    round({share("denial_flag = 'Y'")}, 4) AS denial_rate,
    (SELECT string_agg(code, '|' ORDER BY place) FROM policy_codes c WHERE c.policy_id = m.policy_id) AS top_dx,
    (SELECT string_agg(specialty, '|' ORDER BY place) FROM policy_specialties s WHERE s.policy_id = m.policy_id) AS top_specialties
FROM matched m GROUP BY policy_id""",
)
check("policy_kpis", "kpis", "SELECT * FROM kpis")
check(
    "match_counts",
    "matched",
    """
SELECT count(*) AS claims, count(*) FILTER (WHERE policy_id <> 'unmatched') AS matched,
    count(*) FILTER (WHERE policy_id = 'unmatched') AS unmatched
FROM matched""",
)


def ranked(by: str) -> str:
    def three(name: str) -> str:
        return f"array_to_string(string_split({name}, '|')[1:3], ', ')"

    return f"""
SELECT CAST(row_number() OVER (ORDER BY {by} DESC, policy_id) AS INTEGER) AS place, policy_id,
    {grouped("n_claims", 0)} AS claims, '$' || {grouped("total_amount", 2)} AS total_amount,
    '$' || {grouped("avg_amount", 2)} AS avg_amount,
    printf('%.2f', round(approval_rate * 100, 2)) || '%' AS approval_rate,
    printf('%.2f', round(denial_rate * 100, 2)) || '%' AS denial_rate,
    {three("top_dx")} AS top_dx, {three("top_specialties")} AS top_specialties
FROM kpis"""


check("rank_policies", "kpis", ranked("denial_rate"))
check("report_policy_insights", "kpis", ranked("total_amount"))

# Appeals and benchmarks

step(
    "funnel",
    "claims",
    """
SELECT *, round(total_denials / total_claims, 4) AS overall_denial_rate,
    round(total_appeals / total_denials, 4) AS overall_appeal_rate,
    CAST(total_appeals * 350 AS DOUBLE) AS estimated_admin_cost
FROM (SELECT count(*) AS total_claims, count(*) FILTER (WHERE denial_flag = 'Y') AS total_denials,
        count(*) FILTER (WHERE appeal_flag = 'Y') AS total_appeals,
        count(*) FILTER (WHERE grievance_flag = 'Y') AS total_grievances FROM claims)""",
)
step(
    "categories",
    "claims",
    f"""
SELECT denial_reason_category AS category, count(*) AS denial_count,
    count(*) FILTER (WHERE appeal_flag = 'Y') AS appeal_count, round({share("appeal_flag = 'Y'")}, 4) AS appeal_rate,
    count(*) FILTER (WHERE grievance_flag = 'Y') AS grievance_count,
    {money("billed_amount")} AS total_billed, {money("allowed_amount")} AS total_allowed
FROM claims WHERE denial_flag = 'Y' AND denial_reason_category IS NOT NULL GROUP BY 1""",
)


def denied_providers(table: str) -> str:
    return f"""
SELECT provider_id, count(*) AS total_denials, count(*) FILTER (WHERE appeal_flag = 'Y') AS total_appeals,
    round({share("appeal_flag = 'Y'")}, 4) AS appeal_rate,
    (SELECT COALESCE(denial_reason_category, 'unknown') AS reason FROM {table} o
     WHERE o.provider_id = d.provider_id AND denial_flag = 'Y' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_denial_reason,
    {money("billed_amount")} AS total_billed_denied
FROM {table} d WHERE denial_flag = 'Y' GROUP BY 1"""


check("appeals_funnel", "funnel", "SELECT * FROM funnel")
check("write_reports", "funnel", "SELECT * FROM funnel")
check("denial_categories", "categories", "SELECT * FROM categories")
check("top_denial_categories", "categories", "SELECT * FROM categories ORDER BY denial_count DESC, category LIMIT 5")
check("report_denial_funnel", "categories", "SELECT category, denial_count, appeal_count FROM categories")
check("provider_appeals", "faulty", denied_providers("faulty"))
check(
    "top_appeal_providers",
    "claims",
    f"SELECT * FROM ({denied_providers('claims')}) ORDER BY total_appeals DESC, provider_id LIMIT 10",
)

step(
    "metrics",
    "claims",
    f"""
SELECT 'denial_rate' AS metric_name, round({share("denial_flag = 'Y'")}, 4) AS value FROM claims
UNION ALL SELECT 'oon_rate', round({share("network_status = 'OON'")}, 4) FROM claims
UNION ALL SELECT 'cost_per_claim', round({money("allowed_amount")} / count(*), 2) FROM claims""",
)
step(
    "comparison",
    "metrics",
    """
SELECT metric_name, round(value, 4) AS internal_value, baseline_value, round((value - baseline_value) / baseline_value, 4) AS variance,
    threshold_pct, abs((value - baseline_value) / baseline_value) > threshold_pct AS exceeds_threshold,
    CASE WHEN (value - baseline_value) / baseline_value > threshold_pct THEN 'above'
         WHEN (value - baseline_value) / baseline_value < -threshold_pct THEN 'below' ELSE 'within' END AS direction
FROM metrics JOIN (SELECT * FROM (VALUES ('denial_rate', CAST(0.08 AS DOUBLE), CAST(0.15 AS DOUBLE)),
    ('oon_rate', CAST(0.05 AS DOUBLE), CAST(0.2 AS DOUBLE)), ('cost_per_claim', CAST(1200 AS DOUBLE), CAST(0.1 AS DOUBLE)))
    AS t(metric_name, baseline_value, threshold_pct)) USING (metric_name)""",
)
check("internal_metrics", "metrics", "SELECT * FROM metrics")
check("benchmark_compare", "comparison", "SELECT * FROM comparison")
check("flagged_count", "comparison", "SELECT count(*) FILTER (WHERE exceeds_threshold) AS flagged_count FROM comparison")
check(
    "odd_amounts",
    "claims",
    """
SELECT claim_type, isnan(total) AS not_a_number, NOT isnan(total) AND isinf(total) AS infinite,
    CASE WHEN isfinite(total) THEN round(total, 2) END AS total_allowed
FROM (SELECT claim_type, sum(CASE WHEN claim_type = 'Pharmacy' AND denial_flag = 'Y' THEN CAST('nan' AS DOUBLE)
        WHEN claim_type = 'Institutional' AND denial_flag = 'Y' THEN CAST('inf' AS DOUBLE)
        ELSE CAST(allowed_amount AS DOUBLE) END) AS total FROM claims GROUP BY claim_type)""",
)
check(
    "report_benchmarks",
    "comparison",
    """
SELECT metric_name, internal_value, baseline_value, variance, threshold_pct,
    CASE WHEN exceeds_threshold THEN 'FLAGGED' ELSE 'OK' END AS status
FROM comparison""",
)

# Policy impact


def metrics_of(condition: str, prefix: str) -> str:
    keep = f"FILTER (WHERE {condition})"
    n = f"nullif(count(*) {keep}, 0)"
    total = f"COALESCE(CAST(sum(CAST(allowed_amount AS DECIMAL(18,2))) {keep} AS DOUBLE), 0)"
    return f"""
    count(*) {keep} AS {prefix}volume, {total} AS {prefix}total_allowed, COALESCE({total} / {n}, 0) AS {prefix}avg_allowed,
    COALESCE((count(*) FILTER (WHERE denial_flag = 'Y' AND {condition})) / {n}, 0) AS {prefix}denial_rate,
    COALESCE((count(*) FILTER (WHERE network_status = 'OON' AND {condition})) / {n}, 0) AS {prefix}oon_rate"""


check("period_metrics", "claims", f"SELECT {metrics_of('true', '')} FROM claims")
step(
    "events",
    "",
    """
SELECT * FROM (VALUES
    ('POL-001', 'Imaging without authorization', DATE '1999-07-01', 'CPT-7', '^CPT-7', 'removed'),
    ('POL-002', 'Equipment and visits', DATE '2001-08-15', 'HCPCS-E|CPT-99', '^(HCPCS-E|CPT-99)', 'removed'),
    ('POL-003', 'Laboratory needs authorization', DATE '1998-01-01', 'CPT-80', '^CPT-80', 'added'),
    ('POL-004', 'Nothing affected', DATE '1999-07-01', 'NONEXISTENT', '^NONEXISTENT', 'removed'))
    AS t(policy_id, description, effective, affected_services, pattern, change_type)""",
)


def half_up(value: str, places: int) -> str:
    """Rounding half up on the decimal value of a double, as it is written."""
    return f"CAST(round(CAST(CAST(CAST({value} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,20)), {places}) AS DOUBLE)"


def change_pct(name: str) -> str:
    return half_up(f"CASE WHEN pre_{name} > 0 THEN (post_{name} - pre_{name}) / pre_{name} * 100 ELSE 0 END", 2)


IMPACT = f"""
SELECT policy_id, description, CAST(effective AS VARCHAR) AS effective_date, affected_services, m.* EXCLUDE (id),
    {change_pct("volume")} AS volume_change_pct, {change_pct("total_allowed")} AS cost_change_pct,
    {half_up("post_denial_rate - pre_denial_rate", 4)} AS denial_rate_change,
    {half_up("post_oon_rate - pre_oon_rate", 4)} AS oon_rate_change,
    change_type = 'removed' AND pre_volume > 0 AND post_volume >= pre_volume * 0.8 AS rebound_detected,
    CASE WHEN change_type = 'removed' AND pre_volume > 0 AND post_volume >= pre_volume * 0.8
        THEN 'Post-removal volume (' || post_volume || ') is ' || printf('%.0f', round(post_volume / pre_volume * 100, 0))
            || '% of pre-removal volume (' || pre_volume || '). Utilization did not decrease as expected.'
        ELSE '' END AS rebound_detail
FROM events JOIN (
    SELECT policy_id AS id, {metrics_of("service_date < effective", "pre_")}, {metrics_of("service_date >= effective", "post_")}
    FROM events LEFT JOIN claims ON regexp_matches(procedure_code, pattern)
        AND service_date >= effective - 84 AND service_date < effective + 84
    GROUP BY policy_id) m ON policy_id = id"""
step("impact", "claims events", IMPACT)
step(
    "listed_events",
    "many_events",
    "SELECT *, array_to_string(prefixes, '|') AS affected_services, '^(' || array_to_string(prefixes, '|') || ')' AS pattern FROM many_events",
)
check("policy_impact_from_table", "claims listed_events", IMPACT.replace("FROM events", "FROM listed_events"))
check("policy_impact", "impact", "SELECT * FROM impact")
check(
    "report_policy_impact",
    "impact",
    """
SELECT policy_id, 'Volume' AS metric, CAST(pre_volume AS DOUBLE) AS pre, CAST(post_volume AS DOUBLE) AS post,
    volume_change_pct AS change FROM impact
UNION ALL SELECT policy_id, 'Total Allowed', pre_total_allowed, post_total_allowed, cost_change_pct FROM impact
UNION ALL SELECT policy_id, 'Denial Rate', pre_denial_rate, post_denial_rate, denial_rate_change FROM impact
UNION ALL SELECT policy_id, 'OON Rate', pre_oon_rate, post_oon_rate, oon_rate_change FROM impact""",
)

# Detection


def number(value: str, places: int) -> str:
    return f"CAST(round({value}, {places}) AS VARCHAR)"


def fixed(value: str, places: int) -> str:
    return f"printf('%.{places}f', round({value}, {places}))"


def as_json(**values: str) -> str:
    return "'{' || " + " || ',' || ".join(f"""'"{name}":' || {value}""" for name, value in values.items()) + " || '}'"


def text(name: str) -> str:
    return f"""'"' || {name} || '"'"""


def flag(rule: str, entity: str, severity: str, values: str, threshold: str, actual: str, description: str, source: str) -> str:
    return f"""
SELECT '{rule}' AS rule_name, '{entity}' AS entity_type, provider_id AS entity_id, {severity} AS severity,
    {values} AS feature_values, CAST({threshold} AS DOUBLE) AS threshold, CAST({actual} AS DOUBLE) AS actual_value,
    {description} AS description
FROM {source}"""


def outliers(column: str) -> str:
    return f"""(SELECT *, ({column} - mean) / std AS z, mean + 2 * std AS lim
    FROM providers, (SELECT avg({column}) AS mean, stddev_samp({column}) AS std FROM providers)
    WHERE std > 0 AND {column} > mean + 2 * std)"""


ZSEVERITY = "CASE WHEN z > 3 THEN 'high' ELSE 'medium' END"
FLAGS = {
    "high_volume_provider": flag(
        "high_volume_provider", "provider", ZSEVERITY,
        as_json(total_claims="total_claims", peer_mean=number("mean", 1), peer_std=number("std", 1), z_score=number("z", 2)),
        "round(lim, 1)", "total_claims",
        f"'Provider ' || provider_id || ' has ' || total_claims || ' claims (z-score=' || {fixed('z', 2)} || ', threshold=' || {fixed('lim', 0)} || ')'",
        outliers("total_claims"),
    ),
    "high_cost_provider": flag(
        "high_cost_provider", "provider", ZSEVERITY,
        as_json(total_allowed=fixed("total_allowed", 2), peer_mean=fixed("mean", 2), peer_std=fixed("std", 2), z_score=number("z", 2)),
        "round(lim, 2)", "round(total_allowed, 2)",
        f"'Provider ' || provider_id || ' has $' || {grouped('total_allowed', 2)} || ' total allowed (z-score=' || {fixed('z', 2)} || ', threshold=$' || {grouped('lim', 0)} || ')'",
        outliers("total_allowed"),
    ),
    "new_entity_high_volume": flag(
        "new_entity_high_volume", "provider", "'high'",
        as_json(total_claims="total_claims", entity_age_days="entity_age_days", specialty=text("specialty")),
        "lim", "total_claims",
        "'New provider ' || provider_id || ' (age=' || entity_age_days || 'd) has ' || total_claims || ' claims, exceeding the 90th percentile of established providers (' || printf('%.0f', CAST(lim AS DOUBLE)) || ')'",
        f"""(SELECT * FROM providers, (SELECT {nearest("total_claims", "r", 0.9)} AS lim
            FROM (SELECT total_claims, row_number() OVER (ORDER BY total_claims) AS r, count(*) OVER () AS n
                  FROM providers WHERE entity_age_days >= 90))
            WHERE entity_age_days < 90 AND total_claims > lim)""",
    ),
    "oon_dme_cluster": flag(
        "oon_dme_cluster", "supplier", "'high'",
        as_json(
            oon_rate=number("oon_rate", 3), dme_rate=number("dme_rate", 3), unique_procedure_codes="unique_procedure_codes",
            total_claims="total_claims", total_allowed=fixed("total_allowed", 2), entity_age_days="entity_age_days",
            geography_state=text("geography_state"),
        ),
        "0.8", "round(oon_rate, 3)",
        f"'DME supplier ' || provider_id || ' has ' || {fixed('oon_rate * 100', 0)} || '% OON rate, ' || total_claims || ' claims, only ' || unique_procedure_codes || ' unique codes. Possible OON DME billing scheme.'",
        """(SELECT * FROM providers, (SELECT median(total_claims) AS mid FROM providers WHERE dme_rate > 0.5)
            WHERE dme_rate > 0.5 AND oon_rate > 0.8 AND unique_procedure_codes <= 3 AND total_claims >= mid)""",
    ),
    "billing_ratio_outlier": flag(
        "billing_ratio_outlier", "provider", "'medium'",
        as_json(
            billed_to_allowed_ratio=number("avg_billed_to_allowed_ratio", 3), peer_median_ratio=number("mid", 3),
            total_claims="total_claims",
        ),
        "round(mid * 3, 3)", "round(avg_billed_to_allowed_ratio, 3)",
        f"'Provider ' || provider_id || ' has a billed/allowed ratio of ' || {fixed('avg_billed_to_allowed_ratio', 2)} || ' vs peer median of ' || {fixed('mid', 2)} || ' (threshold=' || {fixed('mid * 3', 2)} || ')'",
        """(SELECT * FROM providers, (SELECT median(avg_billed_to_allowed_ratio) AS mid FROM providers)
            WHERE avg_billed_to_allowed_ratio > mid * 3)""",
    ),
}
for rule, statement in FLAGS.items():
    check(f"flags_{rule}", "providers", statement)
step("flags", "providers", " UNION ALL ".join(f"SELECT * FROM ({statement})" for statement in FLAGS.values()))
ORDER = (
    "ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, "
    + cases([(f"rule_name = '{rule}'", str(i)) for i, rule in enumerate(FLAGS)], "99")
    + ", entity_id"
)
check("all_flags", "flags", "SELECT * FROM flags")
check("sort_flags", "flags", f"SELECT severity, rule_name, entity_id FROM flags {ORDER}")
check("top_flags", "flags", f"SELECT * FROM flags {ORDER} LIMIT 20")
check(
    "report_top_flags",
    "flags",
    f"""
SELECT rule_name, entity_id, severity, round(actual_value, 2) AS actual_value, round(threshold, 2) AS threshold, description
FROM flags {ORDER} LIMIT 20""",
)
check(
    "flag_counts",
    "flags",
    """
SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'high') AS high,
    count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low
FROM flags""",
)
check(
    "provider_peer_stats",
    "providers",
    """
SELECT round(avg(total_claims), 4) AS peer_mean, round(stddev_samp(total_claims), 4) AS peer_std,
    round(avg(total_claims) + 2 * stddev_samp(total_claims), 4) AS threshold
FROM providers""",
)

# Reports and cross-table checks

check(
    "report_key_metrics",
    "claims flags",
    f"""
SELECT 'total_claims' AS metric, CAST(count(*) AS DOUBLE) AS value FROM claims
UNION ALL SELECT 'total_billed', {money("billed_amount")} FROM claims
UNION ALL SELECT 'total_allowed', {money("allowed_amount")} FROM claims
UNION ALL SELECT 'overall_denial_rate', round({share("denial_flag = 'Y'")}, 4) FROM claims
UNION ALL SELECT 'overall_appeal_rate', round((count(*) FILTER (WHERE appeal_flag = 'Y')) / (count(*) FILTER (WHERE denial_flag = 'Y')), 4) FROM claims
UNION ALL SELECT 'oon_rate', round({share("network_status = 'OON'")}, 4) FROM claims
UNION ALL SELECT 'total_flags', CAST(count(*) AS DOUBLE) FROM flags""",
)
check(
    "report_cost_histogram",
    "claims",
    """
SELECT bin, round(lo + (hi - lo) / 100 * (bin - 1), 4) AS bin_start, round(lo + (hi - lo) / 100 * bin, 4) AS bin_end,
    count(place) AS claims
FROM (SELECT CAST(unnest(range(1, 101)) AS INTEGER) AS bin)
CROSS JOIN (SELECT min(allowed_amount) AS lo, max(allowed_amount) AS hi FROM claims)
LEFT JOIN (SELECT least(100, CAST(floor((allowed_amount - lo) * 100 / (hi - lo)) AS BIGINT) + 1) AS place
           FROM claims, (SELECT min(allowed_amount) AS lo, max(allowed_amount) AS hi FROM claims)) ON place = bin
GROUP BY bin, lo, hi""",
)
check(
    "report_utilization_trend",
    "temporal",
    """
SELECT period_start, total_claims, rolling_4w_claims, round(m, 4) AS band_mean, round(m + 2 * s, 4) AS band_upper,
    round(greatest(0, m - 2 * s), 4) AS band_lower
FROM temporal, (SELECT avg(rolling_4w_claims) AS m, stddev_pop(rolling_4w_claims) AS s FROM temporal WHERE period_type = 'weekly')
WHERE period_type = 'weekly'""",
)
check(
    "code_reconciliation",
    "claims",
    f"""
SELECT stage, total_rows, unique_codes, null_codes, (SELECT count(DISTINCT procedure_code) FROM claims) - unique_codes AS dropped_codes,
    0 AS added_codes
FROM (SELECT 'claims' AS stage, count(*) AS total_rows, count(DISTINCT procedure_code) AS unique_codes, 0 AS null_codes FROM claims
    UNION ALL SELECT 'enriched', count(*), count(DISTINCT procedure_code), 0 FROM claims
    UNION ALL SELECT 'seeds', count(*), count(DISTINCT procedure_code), 0 FROM ({clusters(100)}))""",
)
check(
    "concentration_share",
    "claims",
    """
SELECT count(*) AS total_claims, count(*) FILTER (WHERE r <= floor(n * 0.2)) AS top_claims,
    round(CAST(sum(CAST(billed_amount AS DECIMAL(18,2))) FILTER (WHERE r <= floor(n * 0.2)) AS DOUBLE)
        / CAST(sum(CAST(billed_amount AS DECIMAL(18,2))) AS DOUBLE), 6) AS top_share
FROM (SELECT billed_amount, row_number() OVER (ORDER BY billed_amount DESC) AS r, count(*) OVER () AS n FROM claims)""",
)

# Sinks, each table read back in full

check("write_features_claims", "tagged", "SELECT * FROM tagged")
for name, same in (("provider", "provider_features"), ("temporal", "temporal_features"), ("service_category", "service_category_features")):
    ORACLE[f"write_features_{name}"] = ORACLE[same]
for name in (
    "denial_categories", "top_appeal_providers", "benchmark_compare", "policy_impact", "all_flags", "validate_claims",
    "validate_issues", "policy_kpis",
):
    ORACLE[f"write_reports_{name}"] = ORACLE[name]
ORACLE["route_arriving_claims"] = ORACLE["route_valid_rows"]
ORACLE["write_policy_files"] = ORACLE["render_policy_docs"]
for name, same in (("provider", "provider_features"), ("temporal", "temporal_features"), ("service_category", "service_category_features")):
    ORACLE[f"appended_{name}_features"] = ORACLE[same]
for name in ("load_claims", "window_filter"):
    ORACLE[f"{name}_by_month"] = ORACLE[name]
ORACLE["policy_impact_by_month"] = ORACLE["policy_impact_from_table"]
