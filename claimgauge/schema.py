"""The canonical claims schema and the schemas of stored side tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "DOUBLE": T.DoubleType(),
    "BIGINT": T.LongType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """Nullable columns from ``name TYPE`` pairs; needs no running session, unlike a DDL string."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Column names and types of a claims table.
CLAIMS = _struct(
    """
    claim_id STRING, member_id STRING, provider_id STRING, facility_id STRING,
    payer_product STRING, plan_type STRING, line_of_business STRING,
    service_date DATE, claim_received_date DATE, paid_date DATE,
    claim_type STRING, place_of_service STRING, diagnosis_codes STRING,
    procedure_code STRING, revenue_code STRING,
    billed_amount DOUBLE, allowed_amount DOUBLE, paid_amount DOUBLE, units BIGINT,
    network_status STRING, authorization_required STRING, authorization_id STRING,
    denial_flag STRING, denial_reason_category STRING, appeal_flag STRING,
    grievance_flag STRING, dme_flag STRING, supplier_type STRING,
    rendering_npi STRING, billing_npi STRING,
    geography_state STRING, geography_region STRING, specialty STRING
    """
)

# Columns that may be null; every other column is required.
NULLABLE = (
    "facility_id",
    "paid_date",
    "revenue_code",
    "authorization_id",
    "denial_reason_category",
    "supplier_type",
)

REQUIRED = tuple(name for name in CLAIMS.names if name not in NULLABLE)

# The nullable columns that are expected to be mostly empty.
SPARSE = ("facility_id", "paid_date", "revenue_code", "authorization_id", "supplier_type")

# The amount columns, and the values of flags.
AMOUNTS = ("billed_amount", "allowed_amount", "paid_amount")

YES_NO = ("Y", "N")

# The accepted values of the checked columns, in order of checking.
ACCEPTED = {
    "payer_product": ("Commercial", "Medicare", "Medicaid", "Exchange"),
    "plan_type": ("HMO", "PPO", "POS", "EPO"),
    "line_of_business": ("Group", "Individual", "Medicare", "Medicaid"),
    "claim_type": ("Professional", "Institutional", "Pharmacy"),
    "network_status": ("INN", "OON"),
    "denial_flag": YES_NO,
    "appeal_flag": YES_NO,
    "grievance_flag": YES_NO,
    "dme_flag": YES_NO,
    "authorization_required": YES_NO,
    "geography_region": ("Northeast", "Southeast", "Midwest", "West"),
}

# Fixed values.
DENIAL_REASONS = (
    "medical_necessity",
    "not_covered",
    "authorization_missing",
    "coding_error",
    "duplicate",
    "untimely_filing",
)

CODE_COUNTS = T.ArrayType(_struct("code STRING, count BIGINT"))

POLICY_RULE = _struct(
    """
    policy_id STRING, covered_cpt_codes ARRAY<STRING>, site_of_service STRING,
    diagnosis_constraints ARRAY<STRING>, documentation_requirements ARRAY<STRING>,
    source_file STRING
    """
)
