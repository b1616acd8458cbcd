"""Procedure and diagnosis code expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

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
OTHER_CATEGORY = "Other"


def service_category(procedure_code: Column) -> Column:
    branches = F.when(procedure_code.isNull(), F.lit(None).cast("string"))
    for prefix, category in SERVICE_CATEGORIES.items():
        branches = branches.when(procedure_code.startswith(prefix), F.lit(category))
    return branches.otherwise(F.lit(OTHER_CATEGORY))


def has_any_prefix(code: Column, prefixes) -> Column:
    """True when the code starts with one of the prefixes; false when there are none."""
    return reduce(lambda found, prefix: found | code.startswith(prefix), prefixes, F.lit(False))


def diagnosis_list(diagnosis_codes: Column) -> Column:
    """The codes of a JSON list; null when the text is null or not a JSON list."""
    return F.from_json(diagnosis_codes, "array<string>")
