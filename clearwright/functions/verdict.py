"""Verdict vocabulary and its mappings to stages, VEX states and plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_AFFECTED = "NOT_AFFECTED"
AFFECTED = "AFFECTED"
UNDER_INVESTIGATION = "UNDER_INVESTIGATION"

COMPONENT_ABSENT = "component_not_present"
CODE_ABSENT = "vulnerable_code_not_present"

# Justifications that claim a negative nobody can prove.
FORBIDDEN_JUSTIFICATIONS = (
    "vulnerable_code_not_in_execute_path",
    "vulnerable_code_cannot_be_controlled_by_adversary",
    "inline_mitigations_already_exist",
)

# Pipeline stages in evaluation order with the refusals that end there.
STAGES = (
    ("S1", "identity_resolution",
     ("no_identity_mapping", "mapping_probable_only", "version_underivable", "purl_match_insufficient")),
    ("S2", "manifest_lookup", ("manifest_no_entry", "manifest_probable_only")),
    ("S3", "symbol_table_usability", ("symbol_table_unusable",)),
    ("S4", "provenance_gate", ("provenance_unverified",)),
    ("S5", "symbol_stripped_gates", ("stripped_static_binary", "stripped_insufficient_dynsym")),
    ("S5b", "symbol_observability", ("symbol_not_observable",)),
    ("S6", "identity_unverified", ("identity_unverified",)),
    ("S7", "evidence_evaluation", ("default_insufficient",)),
)
STAGE_IDS = tuple(stage for stage, _, _ in STAGES)
DECIDED_STAGE = "S7"
UNKNOWN_STAGE = "S?"

REASONS = tuple(code for _, _, codes in STAGES for code in codes)

# Short labels of refusals in scan summaries.
REASON_LABELS = {
    "manifest_no_entry": "no manifest entry",
    "manifest_probable_only": "probable",
    "stripped_static_binary": "stripped-static",
    "stripped_insufficient_dynsym": "stripped-dynsym",
    "symbol_table_unusable": "symtab-unusable",
    "purl_match_insufficient": "purl-insufficient",
    "no_identity_mapping": "no-identity-mapping",
    "mapping_probable_only": "mapping-probable-only",
    "version_underivable": "version-underivable",
    "provenance_unverified": "provenance-unverified",
    "identity_unverified": "identity-unverified",
}

# Refusals in words.
REASON_WORDS = {
    "manifest_no_entry": "no manifest entry",
    "manifest_probable_only": "probable-only manifest symbols",
    "stripped_static_binary": "stripped static binary",
    "stripped_insufficient_dynsym": "stripped binary with insufficient dynamic symbols",
    "symbol_table_unusable": "symbol table unusable",
    "purl_match_insufficient": "PURL match too weak",
    "identity_unverified": "identity unverified",
}

# Status names of the three VEX formats per verdict.
OPENVEX_STATUS = {
    NOT_AFFECTED: "not_affected", AFFECTED: "affected", UNDER_INVESTIGATION: "under_investigation"}
CYCLONEDX_STATE = {NOT_AFFECTED: "not_affected", AFFECTED: "exploitable", UNDER_INVESTIGATION: "in_triage"}
CSAF_STATUS = {
    NOT_AFFECTED: "known_not_affected", AFFECTED: "known_affected",
    UNDER_INVESTIGATION: "under_investigation"}
VEX_STATUS_KEYS = {
    "not_affected": "known_not_affected", "fixed": "fixed", "affected": "known_affected",
    "under_investigation": "under_investigation"}


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A literal dictionary as a CASE; constant size, so no join is needed."""
    (first, value), *rest = table.items()
    out = F.when(key == first, F.lit(value))
    for k, v in rest:
        out = out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def status_of(verdict: Column, table: dict[str, str]) -> Column:
    """VEX status of a verdict; an unknown verdict fails the job."""
    return lookup(
        verdict, table, F.raise_error(F.concat(F.lit("unknown verdict "), F.coalesce(verdict, F.lit("NULL"))))
    )


def cyclonedx_justification(justification: Column) -> Column:
    return F.when(justification.isin(COMPONENT_ABSENT, CODE_ABSENT), "code_not_present")


def vex_status_key(status: Column) -> Column:
    """Status of an OpenVEX or CycloneDX statement as a CSAF-style key; unknown text passes through."""
    return lookup(F.lower(F.trim(status)), VEX_STATUS_KEYS, status)


def is_decided(verdict: Column) -> Column:
    return verdict.isin(NOT_AFFECTED, AFFECTED)


def stage_id(verdict: Column, reason: Column) -> Column:
    out = F.when(is_decided(verdict), F.lit(DECIDED_STAGE))
    for stage, _, codes in STAGES:
        out = out.when(reason.isin(*codes), F.lit(stage))
    return out.otherwise(F.lit(UNKNOWN_STAGE))


def stage_order(stage: Column) -> Column:
    """Position of a stage, 0-based; NULL for the unknown stage."""
    return lookup(stage, {s: str(i) for i, s in enumerate(STAGE_IDS)}).cast("int")


def reason_label(reason: Column) -> Column:
    return lookup(reason, REASON_LABELS, F.coalesce(F.nullif(reason, F.lit("")), F.lit("unspecified")))


def reason_words(reason: Column) -> Column:
    return lookup(reason, REASON_WORDS, F.coalesce(F.nullif(reason, F.lit("")), F.lit("unspecified")))


# Own wording, by verdict or by (verdict, justification).
VERDICT_WORDS = {
    "AFFECTED": "at risk: a listed symbol is present",
    "UNDER_INVESTIGATION": "open: the evidence does not decide",
    "NOT_AFFECTED": "clear",
    "NOT_AFFECTED/component_not_present": "clear: no binary carries the component",
    "NOT_AFFECTED/vulnerable_code_not_present": "clear: no binary carries a listed symbol",
}
RULE_WORDS = {
    "D01": "D01 (component absent)",
    "D02": "D02 (code absent)",
    "D04": "D04 (code present)",
}
CLOSING_WORDS = {
    "UNDER_INVESTIGATION": "Stays open until more evidence is stored.",
    "NOT_AFFECTED": "Can be derived again from the stored tables.",
}


def verdict_words(verdict: Column, justification: Column) -> Column:
    v = F.upper(verdict)
    return lookup(F.concat_ws("/", v, justification), VERDICT_WORDS, lookup(v, VERDICT_WORDS, verdict))


def rule_words(rule: Column, reason: Column) -> Column:
    refused = F.concat(F.lit("D03 (refused: "), reason_words(reason), F.lit(")"))
    return lookup(rule, RULE_WORDS, F.when(rule == "D03", refused).otherwise(rule))


def closing_words(verdict: Column) -> Column:
    return lookup(verdict, CLOSING_WORDS, F.lit("Have a person read the evidence first."))


def verdict_kind(verdict: Column) -> Column:
    return lookup(
        F.upper(verdict),
        {UNDER_INVESTIGATION: "refusal", NOT_AFFECTED: "not_affected", AFFECTED: "affected"},
        F.lit("other"),
    )


def impact_detail(rule: Column, manifest_version: Column, bundle: Column) -> Column:
    def part(x: Column) -> Column:
        return F.coalesce(F.trim(x), F.lit(""))

    return F.concat(
        F.lit("rule_id="), part(rule), F.lit(" manifest_version="), part(manifest_version),
        F.lit(" bundle_id="), part(bundle),
    )


def evidence_kind(justification: Column, absent: Column) -> Column:
    j = F.lower(justification)
    return (
        F.when(j == COMPONENT_ABSENT, COMPONENT_ABSENT)
        .when((j == CODE_ABSENT) & (F.coalesce(absent, F.lit(0)) > 0), "symbols_absent")
        .when(j == CODE_ABSENT, CODE_ABSENT)
        .otherwise(justification)
    )


def confidence_class(symbols: Column) -> Column:
    """`none`, `definitive` or `probable` for an array of vulnerable symbols."""
    return (
        F.when(F.coalesce(F.size(symbols), F.lit(0)) <= 0, "none")
        .when(F.exists(symbols, lambda s: s["confidence"] == "definitive"), "definitive")
        .otherwise("probable")
    )


def definitive_names(symbols: Column) -> Column:
    return F.array_sort(
        F.transform(F.filter(symbols, lambda s: s["confidence"] == "definitive"), lambda s: s["name"])
    )


def allows_clearing(symbols: Column) -> Column:
    """Non-empty and every symbol definitive."""
    return (F.coalesce(F.size(symbols), F.lit(0)) > 0) & F.forall(
        symbols, lambda s: s["confidence"] == "definitive"
    )


def export_verified(symbols: Column) -> Column:
    """At least one definitive symbol, and all of those seen as dynamic exports."""
    definitive = F.filter(symbols, lambda s: s["confidence"] == "definitive")
    return (F.size(definitive) > 0) & F.forall(
        definitive, lambda s: F.coalesce(s["dynsym_export_verified"], F.lit(False))
    )


def integrity_outcome(expected: Column, present: Column, actual: Column) -> Column:
    """`artifact-unhashed`, `artifact-absent`, `artifact-hash-mismatch` or `ok`, in that order."""
    return (
        F.when(F.coalesce(expected, F.lit("")) == "", "artifact-unhashed")
        .when(~F.coalesce(present, F.lit(False)), "artifact-absent")
        .when(~F.coalesce(actual == expected, F.lit(False)), "artifact-hash-mismatch")
        .otherwise("ok")
    )
