"""Fixed values that the SQL counterparts rely on, written out so that they do not follow the library's own."""

# The columns of a claims table, those that may be null, and those expected to be mostly empty.
COLUMNS = """
    claim_id member_id provider_id facility_id payer_product plan_type line_of_business service_date
    claim_received_date paid_date claim_type place_of_service diagnosis_codes procedure_code revenue_code
    billed_amount allowed_amount paid_amount units network_status authorization_required authorization_id
    denial_flag denial_reason_category appeal_flag grievance_flag dme_flag supplier_type rendering_npi
    billing_npi geography_state geography_region specialty
""".split()
MAY_BE_NULL = "facility_id paid_date revenue_code authorization_id denial_reason_category supplier_type".split()
REQUIRED = [name for name in COLUMNS if name not in MAY_BE_NULL]
SPARSE = "facility_id paid_date revenue_code authorization_id supplier_type".split()
AMOUNTS = "billed_amount allowed_amount paid_amount".split()

# Accepted values, in order of checking.
ACCEPTED = {
    "payer_product": ["Commercial", "Medicare", "Medicaid", "Exchange"],
    "plan_type": ["HMO", "PPO", "POS", "EPO"],
    "line_of_business": ["Group", "Individual", "Medicare", "Medicaid"],
    "claim_type": ["Professional", "Institutional", "Pharmacy"],
    "network_status": ["INN", "OON"],
    "denial_flag": ["Y", "N"],
    "appeal_flag": ["Y", "N"],
    "grievance_flag": ["Y", "N"],
    "dme_flag": ["Y", "N"],
    "authorization_required": ["Y", "N"],
    "geography_region": ["Northeast", "Southeast", "Midwest", "West"],
}
DENIAL_REASONS = "medical_necessity not_covered authorization_missing coding_error duplicate untimely_filing".split()

# Procedure code prefixes and their categories; the first match wins.
SERVICE_CATEGORIES = {
    "HCPCS-E": "DME",
    "HCPCS-K": "DME",
    "CPT-7": "Imaging",
    "CPT-99": "E&M",
    "CPT-2": "Surgical",
    "CPT-3": "Surgical",
    "CPT-4": "Surgical",
    "CPT-5": "Surgical",
    "CPT-6": "Surgical",
}

# Fixed value: the policy document, with %s in every place of a value.
POLICY_DOCUMENT = """\
# Prior Authorization Policy: %s

**Specialty:** %s
**Site of Service (ClaimType):** %s
**Effective Date:** 2024-01-01

---

## 1. Covered Services

This policy applies to procedure code **%s** when rendered by a
**%s** provider in a **%s** setting.

---

## 2. Authorization Criteria

%s

---

## 3. Diagnosis Context

The following diagnosis codes were most frequently associated with
**%s** claims in the reference population (n=%s):

%s

---

## 4. Documentation Requirements

Submitting providers must include:

- Clinical notes supporting medical necessity.
- Diagnosis code(s) from the list above, where applicable.
- Any relevant imaging, lab, or specialist reports.

---

## 5. Cost Reference

| Metric              | Value        |
|---------------------|-------------|
| Average Claim Amount | $%s |
| Median Claim Amount  | $%s |
| 90th Pct Claim Amount| $%s |
| Approval Rate        | %s%% |
| Denial Rate          | %s%% |

---

*This policy is synthetically generated from claims-derived seeds for
analytical purposes only.*
"""
