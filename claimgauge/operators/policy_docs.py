"""Policy documents: rendering them from seeds and parsing them back into rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimgauge.functions.text import file_name_part, fixed, grouped, strip
from claimgauge.operators.joins import join_groups
from claimgauge.operators.seeds import KEYS
from claimgauge.schema import POLICY_RULE

# The document layout. %s stands for a value, %% for a percent sign.
POLICY_TEMPLATE = """\
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
# The criteria lines and the value of an empty diagnosis list.
DIAGNOSIS_CRITERION = "- Requires documentation of Dx in [%s]."
DENIAL_CRITERION = "- Prior authorization required; historical denial rate is %s%%."
ROUTINE_CRITERION = "- Service is routinely approved when clinical criteria are met."
NECESSITY_CRITERION = "- Medical necessity must be established by the treating provider."
NO_DIAGNOSES = "N/A"
ROUTINE_APPROVAL_RATE = 0.9

# Patterns of the parser. (?d) makes "\n" the only line end, (?U) lets classes
# and word boundaries follow Unicode.
CODE_PATTERN = r"(?U)(\bCPT-[\w\d]+\b|\b[0-9]{4,5}[A-Z]?\b)"
TITLE_PATTERN = r"(?mdU)^#\s+Prior Authorization Policy:\s*(.+)$"
SITE_PATTERN = r"(?mdU)\*\*Site of Service \(ClaimType\):\*\*\s*(.+)$"
HEADING_PATTERN = r"^##\s+\d+\.\s+"
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def policy_file_name() -> Column:
    parts = [file_name_part(_text(key)) for key in KEYS]
    return F.concat(F.concat_ws("_", F.lit("POL"), *parts), F.lit(".md"))


def policy_markdown() -> Column:
    """The document of a seed row, as one expression."""
    code, site, specialty = (_text(key) for key in KEYS)
    codes = F.transform("top_diagnosis_codes", lambda entry: entry["code"])
    has_codes = F.size(codes) > 0
    approval, denial = (fixed(F.round(F.col(name) * 100, 1), 1) for name in ("approval_rate", "denial_rate"))
    criteria = F.concat_ws(
        "\n",
        F.when(has_codes, F.format_string(DIAGNOSIS_CRITERION, F.array_join(codes, ", "))),
        F.when(F.col("denial_rate") > 0, F.format_string(DENIAL_CRITERION, denial)),
        F.when(F.col("approval_rate") >= ROUTINE_APPROVAL_RATE, ROUTINE_CRITERION),
        F.lit(NECESSITY_CRITERION),
    )
    listed = F.when(has_codes, codes).otherwise(F.array(F.lit(NO_DIAGNOSES)))
    diagnoses = F.concat(F.lit("  - "), F.array_join(listed, "\n  - "))
    amounts = [
        grouped(F.round(name, 2), 2) for name in ("avg_claim_amount", "p50_claim_amount", "p90_claim_amount")
    ]
    return F.format_string(
        POLICY_TEMPLATE,
        code, specialty, site, code, specialty, site, criteria, code, grouped(F.col("n_claims")), diagnoses,
        *amounts, approval, denial,
    )


def render_policy_docs(seeds: DataFrame) -> DataFrame:
    """``file_name, md``, one row per file name; of colliding seeds the last in key order stays."""
    last = Window.partitionBy("file_name").orderBy(*[F.desc(key) for key in KEYS])
    return (
        seeds.withColumn("file_name", policy_file_name())
        .withColumn("place", F.row_number().over(last))
        .where(F.col("place") == 1)
        .select("file_name", policy_markdown().alias("md"))
    )


def _section(md: Column, title: str) -> Column:
    """Text below the first numbered heading that contains ``title``, up to the next one."""
    pattern = rf"(?msdU){HEADING_PATTERN}[^\n]*(?iu:\Q{title}\E)[^\n]*$(.*?)(?={HEADING_PATTERN}[^\n]|\z)"
    return F.regexp_extract(md, pattern, 1)


def _bullets(section: Column) -> Column:
    lines = F.transform(F.split(section, LINE_ENDS), strip)
    items = F.filter(lines, lambda line: line.startswith("- ") | line.startswith("* "))
    return F.transform(items, lambda line: strip(F.substring(line, 3, 1_000_000_000)))


def parse_policy_docs(docs: DataFrame) -> DataFrame:
    """Rules of ``file_name, md`` rows; the rule id is the file name without its extension.

    Without a file name the id is the procedure code of the title.
    """
    md = F.col("md")
    stem = F.regexp_replace("file_name", r"\.md$", "")
    title = strip(F.regexp_extract(md, TITLE_PATTERN, 1))
    diagnoses = F.filter(
        _bullets(_section(md, "Diagnosis Context")),
        lambda code: (code != "") & (F.upper(code) != NO_DIAGNOSES),
    )
    columns = {
        "policy_id": F.when(F.coalesce(stem, F.lit("")) != "", stem).otherwise(title),
        "covered_cpt_codes": F.array_distinct(F.regexp_extract_all(md, F.lit(CODE_PATTERN), F.lit(1))),
        "site_of_service": strip(F.regexp_extract(md, SITE_PATTERN, 1)),
        "diagnosis_constraints": diagnoses,
        "documentation_requirements": _bullets(_section(md, "Documentation Requirements")),
        "source_file": F.col("file_name"),
    }
    return docs.select(*[columns[field.name].alias(field.name) for field in POLICY_RULE])


def roundtrip_check(seeds: DataFrame, rules: DataFrame) -> DataFrame:
    """Per seed: do its code, site and diagnosis codes appear in the rule parsed from its document?"""
    named = seeds.withColumn("source_file", policy_file_name())
    joined = join_groups(named, rules, ["source_file"])
    codes = F.transform("top_diagnosis_codes", lambda entry: entry["code"])
    return joined.select(
        *KEYS,
        F.coalesce(F.array_contains("covered_cpt_codes", F.col("procedure_code")), F.lit(False)).alias("code_found"),
        F.coalesce(F.col("site_of_service") == F.col("claim_type"), F.lit(False)).alias("site_equal"),
        F.coalesce(F.size(F.array_except(codes, "diagnosis_constraints")) == 0, F.lit(False)).alias("diagnoses_found"),
    )
