from __future__ import annotations

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from claimgauge.schema import CLAIMS  # noqa: E402

BASE = {
    "member_id": "M1",
    "provider_id": "P1",
    "payer_product": "Commercial",
    "plan_type": "PPO",
    "line_of_business": "Group",
    "service_date": dt.date(2024, 1, 15),
    "claim_type": "Professional",
    "place_of_service": "11",
    "diagnosis_codes": '["DX-1"]',
    "procedure_code": "CPT-99201",
    "billed_amount": 150.0,
    "allowed_amount": 120.0,
    "paid_amount": 100.0,
    "units": 1,
    "network_status": "INN",
    "authorization_required": "N",
    "denial_flag": "N",
    "appeal_flag": "N",
    "grievance_flag": "N",
    "dme_flag": "N",
    "rendering_npi": "1",
    "billing_npi": "1",
    "geography_state": "PA",
    "geography_region": "Northeast",
    "specialty": "Internal Medicine",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("claimgauge-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_claims(spark):
    """A claims table from partial rows; everything left out has an ordinary value."""

    def make(*rows):
        full = []
        for i, row in enumerate(rows, 1):
            claim = {**BASE, "claim_id": f"C{i}", **row}
            claim.setdefault("claim_received_date", claim["service_date"] + dt.timedelta(5))
            full.append(tuple(claim.get(name) for name in CLAIMS.names))
        return spark.createDataFrame(full, CLAIMS)

    return make


@pytest.fixture(scope="session")
def five_claims(make_claims):
    """Three providers: Q1 with two plain claims, Q2 denied and appealed, Q3 with equipment from outside the network."""
    visit = {"provider_id": "Q1", "specialty": "Geriatrics", "procedure_code": "CPT-99205"}
    equipment = {"provider_id": "Q3", "member_id": "A3"}
    return make_claims(
        {**visit, "service_date": dt.date(2023, 2, 6), "billed_amount": 90.0, "allowed_amount": 64.0},
        {
            **visit, "member_id": "A2", "service_date": dt.date(2023, 2, 27), "procedure_code": "CPT-74177", "specialty": "Radiology",
            "billed_amount": 730.0, "allowed_amount": 455.0,
        },
        {
            "provider_id": "Q2", "claim_type": "Institutional", "service_date": dt.date(2023, 3, 13), "procedure_code": "CPT-62323",
            "denial_flag": "Y", "denial_reason_category": "coding_error", "appeal_flag": "Y", "billed_amount": 2650.0, "allowed_amount": 1840.0,
        },
        {
            **equipment, "service_date": dt.date(2023, 5, 22), "network_status": "OON", "procedure_code": "HCPCS-E1130", "dme_flag": "Y",
            "units": 2, "billed_amount": 510.0, "allowed_amount": 408.0,
        },
        {**equipment, "service_date": dt.date(2023, 6, 19), "procedure_code": "CPT-99214", "billed_amount": 132.0, "allowed_amount": 96.0},
    )


def by_key(df, key):
    return {row[key]: row for row in df.collect()}
