"""Queries of the decision side: resolution, joins, rules and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwright.operators import decide as D
from clearwright.operators import metrics as M
from clearwright.operators import resolve as R
from clearwright.operators.tables import once
from clearwright.plans import sqltext as Q
from clearwright.plans import views as W
from clearwright.plans.registry import query


def catalogue(spark: SparkSession, sf: str) -> D.Catalogue:
    return D.Catalogue(
        components=W.components(spark, sf), component_purls=W.component_purls(spark, sf),
        entries=W.entries(spark, sf), entry_symbols=W.entry_symbols(spark, sf),
        aliases=W.aliases(spark, sf), identity_symbols=W.identity_symbols(spark, sf),
        identity_strings=W.identity_strings(spark, sf),
    )


def binary_facts(spark: SparkSession, sf: str) -> D.BinaryFacts:
    return D.BinaryFacts(
        inventories=W.inventories(spark, sf), symbols=W.symbols(spark, sf), ro_strings=W.ro_strings(spark, sf)
    )


def input_files(sf: str) -> list[str]:
    """The tables that decisions are made from."""
    return [f"{sf}/{name}.parquet" for name in ("lineitem", "part", "benchmark", "documents")]


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The decision table, stored once for its input files and read by every report."""
    return once(spark, "decisions", input_files(sf), lambda: D.decide(
        W.findings(spark, sf), catalogue(spark, sf), binary_facts(spark, sf)))


def staged(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with stage and artifact class; unlisted artifacts are `unknown`."""
    classes = W.artifacts(spark, sf).select("artifact_id", "class")
    return M.with_class(D.stages(decisions(spark, sf)), classes)


@query("p01_normalized_findings", Q.select([W.FINDINGS], "SELECT * FROM findings"))
def _(spark, sf):
    return W.findings(spark, sf)


@query("dx2_quarantined_findings", Q.select(
    [W.FINDINGS], "SELECT artifact_id, cve, component_purl, 'unparseable component_purl' AS detail "
                  "FROM findings WHERE NOT starts_with(component_purl, 'pkg:')"))
def _(spark, sf):
    return D.quarantine(W.findings(spark, sf))


@query("j01_direct_component_match", Q.select(
    Q.DIRECT, "SELECT component_purl, direct_quality, direct_component FROM direct"))
def _(spark, sf):
    return R.direct_matches(W.findings(spark, sf), W.component_purls(spark, sf)).select(
        "component_purl", "direct_quality", "direct_component")


@query("j02_alias_lookup", Q.select(
    Q.IDENTITY, "SELECT component_purl, source_name, alias_status, mapped_text, identity_refusal FROM identity_step"))
def _(spark, sf):
    direct = R.direct_matches(W.findings(spark, sf), W.component_purls(spark, sf))
    return R.with_identity(direct, W.aliases(spark, sf)).select(
        "component_purl", "source_name", "alias_status", "mapped_text", "identity_refusal")


@query("j03_resolved_purls", Q.select(
    Q.RESOLVED, "SELECT component_purl, valid, quality, component, identity_refusal FROM resolved_purls"))
def _(spark, sf):
    return R.resolve_purls(W.findings(spark, sf), W.component_purls(spark, sf), W.aliases(spark, sf)).select(
        "component_purl", "valid", "quality", "component", "identity_refusal")


@query("j04_entry_lookup", Q.select(
    Q.OPEN, "SELECT artifact_id, cve, component_purl, component, n_definitive, early_reason FROM resolved_findings"))
def _(spark, sf):
    return D.resolved_findings(W.findings(spark, sf), catalogue(spark, sf)).select(
        "artifact_id", "cve", "component_purl", "component", "n_definitive", "early_reason")


def affected_ranges(spark, sf):
    """Affected from 1.10.0 on and fixed in 1.30.0, for the entries of every second component."""
    some = W.entries(spark, sf).where(W.name_code(F.col("component")) % 2 == 0).select("component", "cve").distinct()
    return some.withColumn("ecosystem", F.explode(F.array(F.lit("deb"), F.lit("rpm"), F.lit("apk")))).select(
        "component", "cve", "ecosystem", F.lit("1.10.0").alias("introduced"), F.lit("1.30.0").alias("fixed"))


# An epoch is beyond any range without one; below 1.30.0 only a smaller minor number is.
_GATED = f"""gated AS (
  SELECT r.*, purl_type IN ('deb','rpm','apk') AND {W.code_sql('r.component')} % 2 = 0 AND has_slice AND version <> ''
    AND (contains(version, ':') OR minor < 10 OR minor >= 30) AS outside
  FROM (SELECT r.*, p.version, CAST(nullif(regexp_extract(p.version, '^(?:[0-9]+:)?1[.]([0-9]+)[.]0', 1), '') AS INTEGER) AS minor
        FROM resolved_findings r JOIN parsed_findings p ON r.component_purl = p.component_purl) r)"""


@query("j04_entry_lookup_with_version_gate", Q.select([*Q.OPEN, _GATED], """
SELECT artifact_id, cve, component_purl, component, CASE WHEN NOT coalesce(outside, FALSE) THEN n_definitive END AS n_definitive,
  CASE WHEN coalesce(outside, FALSE) AND coalesce(early_reason, 'manifest_probable_only') = 'manifest_probable_only' THEN 'manifest_no_entry' ELSE early_reason END AS early_reason
FROM gated"""))
def _(spark, sf):
    return D.resolved_findings(W.findings(spark, sf), catalogue(spark, sf), affected_ranges(spark, sf)).select(
        "artifact_id", "cve", "component_purl", "component", "n_definitive", "early_reason")


@query("j05_symbol_identity_hits", Q.select(
    Q.HITS, "SELECT artifact_id, inventory_id, component, reason FROM symbol_hits"))
def _(spark, sf):
    return D.symbol_identity_hits(W.symbols(spark, sf), W.identity_symbols(spark, sf))


@query("j06_string_identity_hits", Q.select(
    Q.HITS, "SELECT artifact_id, inventory_id, component, reason FROM string_hits"))
def _(spark, sf):
    return D.string_identity_hits(W.ro_strings(spark, sf), W.identity_strings(spark, sf))


@query("j07_component_inventories", Q.select(
    Q.MEMBERS, "SELECT artifact_id, component, inventory_id, kind, reason, stripped, static_linked, has_dynamic FROM members"))
def _(spark, sf):
    return D.component_inventories(binary_facts(spark, sf), catalogue(spark, sf)).select(
        "artifact_id", "component", "inventory_id", "kind", "reason", "stripped", "static_linked", "has_dynamic")


@query("j08_observed_definitive_symbols", Q.select(
    Q.OBSERVED, "SELECT artifact_id, component, cve, array_to_string(symbols_observed, ',') AS symbols_observed, "
                "array_to_string(symbols_absent, ',') AS symbols_absent FROM observed"))
def _(spark, sf):
    wanted = D.resolved_findings(W.findings(spark, sf), catalogue(spark, sf)).where(
        F.col("has_entry").isNotNull()).select("artifact_id", "component", "cve").distinct()
    return D.observed_per_entry(wanted, W.symbols(spark, sf), W.entry_symbols(spark, sf)).select(
        "artifact_id", "component", "cve", F.array_join("symbols_observed", ",").alias("symbols_observed"),
        F.array_join("symbols_absent", ",").alias("symbols_absent"))


@query("d00_decisions", Q.select(
    Q.DECISIONS, "SELECT artifact_id, cve, component_purl, verdict, justification, rule_id, reason_code, component, "
                 "statement_id, purl_match_quality FROM decisions"))
def _(spark, sf):
    return decisions(spark, sf).select(
        "artifact_id", "cve", "component_purl", "verdict", "justification", "rule_id", "reason_code", "component",
        "statement_id", "purl_match_quality")


def _outcome(name: str, condition: str) -> None:
    """Findings that end at one rule or refusal."""
    @query(name, Q.select(Q.DECISIONS, f"SELECT artifact_id, cve, component_purl, component FROM decisions WHERE {condition}"))
    def _(spark, sf):
        return decisions(spark, sf).where(condition).select("artifact_id", "cve", "component_purl", "component")


for _name, _code in (
    ("d03a", "no_identity_mapping"), ("d03b", "mapping_probable_only"), ("d03c", "version_underivable"),
    ("d03d", "purl_match_insufficient"), ("d03e", "manifest_no_entry"), ("d03f", "manifest_probable_only"),
    ("d03g", "symbol_table_unusable"), ("d03h", "provenance_unverified"), ("d03i", "stripped_static_binary"),
    ("d03j", "stripped_insufficient_dynsym"), ("d03k", "identity_unverified"), ("d03l", "symbol_not_observable"),
    ("d03m", "default_insufficient"),
):
    _outcome(f"{_name}_{_code}", f"reason_code = '{_code}'")
_outcome("d04_affected", "rule_id = 'D04'")
_outcome("d02_code_absent", "rule_id = 'D02'")
_outcome("d01_component_absent", "rule_id = 'D01'")


@query("dx1_inputs_used", Q.select(Q.DECISIONS, """
SELECT artifact_id, cve, component_purl, purl_match_quality, component, CASE WHEN has_slice THEN n_members END AS n_component_inventories,
  array_to_string(symbols_observed, ',') AS symbols_observed, array_to_string(symbols_absent, ',') AS symbols_absent FROM decisions"""))
def _(spark, sf):
    return decisions(spark, sf).select(
        "artifact_id", "cve", "component_purl", "purl_match_quality", "component", "n_component_inventories",
        F.array_join("symbols_observed", ",").alias("symbols_observed"), F.array_join("symbols_absent", ",").alias("symbols_absent"))


@query("dx1_symbols_in_component_only", Q.select([*Q.DECISIONS, """in_component AS (
  SELECT w.artifact_id, w.component, w.cve, list_sort(list(DISTINCT e.symbol)) AS own
  FROM (SELECT DISTINCT artifact_id, component, cve FROM decisions WHERE has_slice) w
  JOIN entry_symbols e ON w.component = e.component AND w.cve = e.cve AND e.confidence = 'definitive'
  JOIN members m ON m.artifact_id = w.artifact_id AND m.component = w.component
  JOIN symbols s ON s.artifact_id = m.artifact_id AND s.inventory_id = m.inventory_id AND (s.raw = e.symbol OR s.normalized = e.symbol)
  GROUP BY ALL)"""], """
SELECT artifact_id, cve, component_purl, verdict, array_to_string(symbols_observed, ',') AS symbols_observed,
  CASE WHEN symbols_observed IS NOT NULL THEN coalesce(array_to_string(own, ','), '') END AS symbols_in_component_only
FROM decisions LEFT JOIN in_component USING (artifact_id, component, cve) WHERE has_slice"""))
def _(spark, sf):
    return decisions(spark, sf).where("has_slice").select(
        "artifact_id", "cve", "component_purl", "verdict", F.array_join("symbols_observed", ",").alias("symbols_observed"),
        F.array_join("symbols_in_component_only", ",").alias("symbols_in_component_only"))


@query("w02_best_match_first_on_ties", Q.select(Q.DIRECT, """
SELECT direct_component, direct_quality, count(*) AS n FROM direct GROUP BY direct_component, direct_quality"""))
def _(spark, sf):
    direct = R.direct_matches(W.findings(spark, sf), W.component_purls(spark, sf))
    return direct.groupBy("direct_component", "direct_quality").agg(F.count(F.lit(1)).alias("n"))


@query("o01_sorted_statements", Q.select(Q.DECISIONS, """
SELECT artifact_id, cve, component_purl, CAST(row_number() OVER (PARTITION BY artifact_id, cve ORDER BY component_purl, statement_id) AS INTEGER) AS position
FROM decisions WHERE has_slice"""))
def _(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("artifact_id", "cve").orderBy("component_purl", "statement_id")
    rows = decisions(spark, sf).where("has_slice")
    return rows.select("artifact_id", "cve", "component_purl", F.row_number().over(order).alias("position"))
