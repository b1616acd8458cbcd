"""Claims derived from order tables (``lineitem``, ``orders``, ``customer``).

One order line becomes one claim. Orders meet customers first, so that the large line table is
shuffled at most once; join strategies are left to the optimizer, which knows the table sizes.
Categories are looked up in constant arrays: chains of conditions for 33 columns would make the
generated code too long to be compiled to machine code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimgauge.schema import CLAIMS


def _array(*values) -> str:
    return f"array({', '.join(repr(value) for value in values)})"


# Values by remainder: payer and line of business by u2 % 20, reasons by u2 % 6 and so on.
PAYERS = _array(*["Commercial"] * 9, *["Medicare"] * 5, *["Medicaid"] * 4, *["Exchange"] * 2)
LINES = _array(*["Group"] * 9, *["Medicare"] * 5, *["Medicaid"] * 4, *["Individual"] * 2)
PLANS = _array("HMO", "PPO", "POS", "EPO")
PLACES = _array("11", "21", "23", "12")
REASONS = _array(
    "medical_necessity", "not_covered", "authorization_missing", "coding_error", "duplicate", "untimely_filing"
)
APPEAL_SHARES = _array(40, 15, 30, 10, 5, 2, 0)
STATES = _array("PA", "FL", "OH", "CA")
REGIONS = _array("Northeast", "Southeast", "Midwest", "West")
SPECIALTIES = _array("Radiology", "Cardiology", "Orthopedics", "DME Supplier")

# Twenty families of procedure codes by shares of u2 % 100, then clusters (20) and pharmacies (21);
# ten codes each, by the last digit of the part (for clusters, of u1).
CODE_FAMILIES = (
    *[[f"CPT-99{201 + digit % 5}" for digit in range(10)]] * 7,
    *[[f"CPT-70{100 + digit % 5}" for digit in range(10)]] * 4,
    *[[f"CPT-{2 + digit % 5}100" for digit in range(10)]] * 3,
    *[[f"HCPCS-E0{110 + digit}" for digit in range(10)]] * 2,
    *[[f"CPT-80{100 + digit % 5}" for digit in range(10)]] * 4,
    [f"HCPCS-E010{digit % 2}" for digit in range(10)],
    [f"RX-0{1000 + digit % 5}" for digit in range(10)],
)
CODES = _array(*[code for family in CODE_FAMILIES for code in family])
# Seven first diagnoses, each followed by one of eleven others or by none.
DIAGNOSES = _array(
    *[
        f'["DX-{1000 + first}{other}"]'
        for first in range(7)
        for other in [*[f'", "DX-{2000 + i}' for i in range(11)], ""]
    ]
)

# Each layer uses the columns of the layer before.
NUMBERS = {
    "u1": "CAST((l_orderkey * 131 + l_linenumber * 17 + l_partkey * 7 + l_suppkey) % 1000 AS INT)",
    "u2": "CAST((l_orderkey * 37 + l_linenumber * 101 + l_partkey * 13 + l_suppkey * 3) % 1009 AS INT)",
    "u3": "CAST((l_orderkey * 59 + l_linenumber + l_partkey * 29 + l_suppkey * 5) % 997 AS INT)",
    "prov": "if(l_partkey % 10 = 0, l_suppkey - l_suppkey % 20, l_suppkey)",
}
REMAINDERS = {
    "cluster": "prov % 20 = 0",
    "u1_100": "u1 % 100",
    "u2_100": "u2 % 100",
    "u3_100": "u3 % 100",
    "payer": "u2 % 20",
    "reason": "u2 % 6",
    "region": "CAST(prov % 4 AS INT)",
    "delay": "u2 % 30",
}
BASICS = {
    "denied": "NOT cluster AND u3_100 < 12",
    "authorized": "NOT cluster AND u2 % 4 = 1",
    "claim_type": "CASE WHEN cluster OR u1_100 < 60 THEN 'Professional' WHEN u1_100 < 85 THEN 'Institutional' ELSE 'Pharmacy' END",
    "service_date": "if(cluster, DATE '2001-08-01' + u1 % 60, CAST(l_shipdate AS DATE))",
    "allowed_amount": "floor(l_extendedprice * if(prov % 20 = 7, 5, 40 + u1 % 56)) / 100",
}
KINDS = {"code_kind": "if(cluster, 20, if(claim_type = 'Pharmacy', 21, CAST(u2_100 DIV 5 AS INT)))"}
COLUMNS = {
    "claim_id": "concat_ws('-', 'CLM', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "member_id": "concat('MEM-', o_custkey)",
    "provider_id": "concat('PROV-', prov)",
    "facility_id": "if(u2 % 10 >= 3, concat('FAC-', prov % 20), NULL)",
    "payer_product": f"get({PAYERS}, payer)",
    "plan_type": f"get({PLANS}, u3 % 4)",
    "line_of_business": f"get({LINES}, payer)",
    "service_date": "service_date",
    "claim_received_date": "service_date + (1 + delay)",
    "paid_date": "if(u3 % 20 = 0, NULL, service_date + (15 + delay + u1 % 77))",
    "claim_type": "claim_type",
    "place_of_service": f"get({PLACES}, if(cluster, 3, u1 % 3))",
    "diagnosis_codes": f"get({DIAGNOSES}, u2 % 7 * 12 + if(u3 % 3 = 0, 11, u1 % 11))",
    "procedure_code": f"get({CODES}, code_kind * 10 + CAST(if(cluster, u1, l_partkey) % 10 AS INT))",
    "revenue_code": "if(claim_type = 'Institutional', concat('0', 100 + u3 % 800), NULL)",
    "billed_amount": "l_extendedprice",
    "allowed_amount": "allowed_amount",
    "paid_amount": "if(denied, 0D, floor(allowed_amount * 90) / 100)",
    "units": "CAST(l_quantity AS BIGINT)",
    "network_status": "if(if(cluster, u3_100 < 95, u3 % 10 = 3), 'OON', 'INN')",
    "authorization_required": "if(authorized, 'Y', 'N')",
    "authorization_id": "if(authorized AND u1 % 10 > 0, concat('AUTH-', u1), NULL)",
    "denial_flag": "if(denied, 'Y', 'N')",
    "denial_reason_category": f"if(denied, get({REASONS}, reason), NULL)",
    "appeal_flag": f"if(u1_100 < get({APPEAL_SHARES}, if(denied, reason, 6)), 'Y', 'N')",
    "grievance_flag": "if(u2 % 50 = 7, 'Y', 'N')",
    "dme_flag": "if(code_kind IN (14, 15, 20), 'Y', 'N')",
    "supplier_type": "if(cluster, 'DME Supplier', NULL)",
    "rendering_npi": "concat('NPI', prov)",
    "billing_npi": "concat('NPI', prov)",
    "geography_state": f"get({STATES}, region)",
    "geography_region": f"get({REGIONS}, region)",
    "specialty": f"get({SPECIALTIES}, CAST(if(cluster, 3, prov % 3) AS INT))",
}

#: What the claims are derived from; a third as wide as the claims.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "o_custkey")


def _spread(lines: DataFrame) -> DataFrame:
    """Give every core a share of a line table with fewer splits than the session has cores.

    Such a table is small by definition; larger ones are not shuffled here.
    """
    cores = lines.sparkSession.sparkContext.defaultParallelism
    return lines.repartition(cores, "l_orderkey") if lines.rdd.getNumPartitions() < cores else lines


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines that have a customer, in the columns that claims are derived from."""
    lines = _spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    # Customer keys are unique, so keeping the orders that have a customer equals joining them.
    owned = orders.join(customers, orders.o_custkey == customers.c_custkey, "left_semi")
    return lines.join(owned, lines.l_orderkey == owned.o_orderkey).select(*LINE)


def derive(lines: DataFrame, names: list[str], kept: list[str]) -> DataFrame:
    """The claims columns ``names`` of every line, after the columns ``kept`` of the line itself."""
    layered = lines
    for layer in (NUMBERS, REMAINDERS, BASICS, KINDS):
        layered = layered.selectExpr("*", *[f"{text} AS {name}" for name, text in layer.items()])
    return layered.selectExpr(*kept, *[f"{COLUMNS[name]} AS {name}" for name in names])


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(order_lines(spark, sf_dir), CLAIMS.names, [])
