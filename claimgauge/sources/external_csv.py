"""Ten-column insurance claims CSV files, mapped to the canonical schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimgauge.functions.text import strip
from claimgauge.schema import CLAIMS

# The columns such a file must have.
EXTERNAL_COLUMNS = (
    "ClaimID",
    "PatientID",
    "ProviderID",
    "ClaimAmount",
    "ClaimDate",
    "DiagnosisCode",
    "ProcedureCode",
    "ProviderSpecialty",
    "ClaimType",
    "ClaimStatus",
)

# What every external claim gets for columns the file does not have.
DEFAULTS = {
    "payer_product": "Commercial",
    "plan_type": "PPO",
    "line_of_business": "Group",
    "place_of_service": "11",
    "network_status": "INN",
    "authorization_required": "N",
    "appeal_flag": "N",
    "grievance_flag": "N",
    "dme_flag": "N",
    "geography_state": "PA",
    "geography_region": "Northeast",
}
DENIED_STATUSES = ("denied", "rejected")
DENIED_REASON = "medical_necessity"
UNKNOWN_DIAGNOSIS = "UNKNOWN"
ALLOWED_SHARE = 0.8
PAID_SHARE = 0.7
DAYS_TO_PAYMENT = 30


def read_external_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The ten columns, typed. An unreadable amount fails the job, an unreadable date is null.

    An empty unquoted field is null and a quoted empty one (``""``) is an empty string; a quote inside a
    quoted field is doubled. A row with more or fewer fields than the header fails the job, as does a file
    whose header differs from the first one's. Quoted line breaks are such rows, unless ``multi_line`` is
    set, which reads each file in one task.
    """
    # With its default, "", the null marker would swallow quoted empty fields as well.
    options = {"header": True, "nullValue": "\0", "mode": "FAILFAST", "enforceSchema": False, "columnPruning": False,
               "escape": '"', "multiLine": multi_line}
    raw = spark.read.options(**options).csv(path)
    raw = raw.toDF(*[name.strip() for name in raw.columns])
    missing = sorted(set(EXTERNAL_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}. Found columns: {sorted(raw.columns)}")
    return raw.select(*EXTERNAL_COLUMNS).withColumns(
        {
            "ClaimAmount": strip(F.col("ClaimAmount")).cast("double"),
            "ClaimDate": F.try_to_date("ClaimDate", "yyyy-MM-dd"),
        }
    )


def adapt_external_claims(external: DataFrame) -> DataFrame:
    """External columns to the 33 canonical ones; row by row, so streams work as well."""
    amount = F.col("ClaimAmount")
    # A null status is not a denial.
    denied = F.coalesce(F.lower("ClaimStatus").isin(*DENIED_STATUSES), F.lit(False))
    kind = F.lower("ClaimType")
    diagnosis = F.when(F.col("DiagnosisCode") == "", F.lit(UNKNOWN_DIAGNOSIS)).otherwise(
        F.col("DiagnosisCode")
    )
    derived = {
        "claim_id": F.col("ClaimID"),
        "member_id": F.col("PatientID"),
        "provider_id": F.col("ProviderID"),
        "service_date": F.col("ClaimDate"),
        "claim_received_date": F.col("ClaimDate"),
        "paid_date": F.when(~denied, F.date_add("ClaimDate", DAYS_TO_PAYMENT)),
        "claim_type": F.when(kind.contains("pharm"), "Pharmacy")
        .when(kind.contains("inst"), "Institutional")
        .otherwise("Professional"),
        "diagnosis_codes": F.when(diagnosis.isNotNull(), F.to_json(F.array(diagnosis))),
        "procedure_code": F.col("ProcedureCode"),
        "billed_amount": amount,
        "allowed_amount": amount * ALLOWED_SHARE,
        "paid_amount": F.when(denied, F.lit(0.0)).otherwise(amount * PAID_SHARE),
        "units": F.lit(1),
        "denial_flag": F.when(denied, "Y").otherwise("N"),
        "denial_reason_category": F.when(denied, DENIED_REASON),
        "rendering_npi": F.col("ProviderID"),
        "billing_npi": F.col("ProviderID"),
        "specialty": F.col("ProviderSpecialty"),
    }
    derived.update({name: F.lit(value) for name, value in DEFAULTS.items()})
    return external.select(
        *[
            derived.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in CLAIMS
        ]
    )


def load_external_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return adapt_external_claims(read_external_csv(spark, path, multi_line))
