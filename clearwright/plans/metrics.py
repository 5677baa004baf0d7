"""Queries of the corpus metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwright.functions import stats
from clearwright.functions import verdict as V
from clearwright.operators import decide as D
from clearwright.operators import metrics as M
from clearwright.operators import sampling as S
from clearwright.plans import sqltext as Q
from clearwright.plans import views as W
from clearwright.plans.decisions import decisions, staged
from clearwright.plans.registry import query

SEED = 20260824

_GRID = f"""{Q.STAGE_ROWS},
scopes AS (SELECT unnest(['all','firmware','substitute-container']) AS scope),
counted AS (
  SELECT scope, stage_id, count(*) AS n FROM (
    SELECT 'all' AS scope, stage_id FROM staged
    UNION ALL SELECT class, stage_id FROM staged WHERE class IN ('firmware','substitute-container'))
  GROUP BY scope, stage_id),
grid AS (
  SELECT s.scope, d.ord, d.stage_id, d.stage_name, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
    CAST((SELECT coalesce(sum(n), 0) FROM counted t WHERE t.scope = s.scope) AS BIGINT) AS total
  FROM scopes s, stage_dim d LEFT JOIN counted c ON c.scope = s.scope AND c.stage_id = d.stage_id)"""


@query("a06_stage_histogram", Q.select([*Q.STAGED, _GRID], """
SELECT scope, stage_id, stage_name, n AS "count",
  CASE WHEN total = 0 THEN 0.0 ELSE round(100.0 * CAST(n AS DOUBLE) / total, 4) END AS percent,
  CASE WHEN total = 0 THEN 0.0 ELSE round(100.0 * CAST(sum(n) OVER (PARTITION BY scope ORDER BY ord) AS DOUBLE) / total, 4) END AS cumulative_percent
FROM grid"""))
def _(spark, sf):
    return M.stage_histogram(staged(spark, sf))


@query("w01_cumulative_stage_counts", Q.select([*Q.STAGED, _GRID], """
SELECT scope, stage_id, CAST(sum(n) OVER (PARTITION BY scope ORDER BY ord) AS BIGINT) AS running FROM grid"""))
def _(spark, sf):
    from pyspark.sql import Window

    h = M.stage_histogram(staged(spark, sf))
    order = Window.partitionBy("scope").orderBy(V.stage_order(F.col("stage_id")))
    return h.select("scope", "stage_id", F.sum("count").over(order).alias("running"))


@query("k09_stage_report_rows", Q.select([*Q.STAGED, _GRID], """
SELECT scope, stage_id, stage_name, n AS "count", printf('%.4f', CASE WHEN total = 0 THEN 0.0 ELSE 100.0 * CAST(n AS DOUBLE) / total END) AS percent
FROM grid"""))
def _(spark, sf):
    h = M.stage_histogram(staged(spark, sf))
    return h.select("scope", "stage_id", "stage_name", "count", F.format_string("%.4f", "percent").alias("percent"))


@query("f41_stage_of_decision", Q.select(Q.STAGED, """
SELECT artifact_id, verdict, reason_code, stage_id, count(*) AS n FROM staged GROUP BY ALL"""))
def _(spark, sf):
    return D.stages(decisions(spark, sf)).groupBy("artifact_id", "verdict", "reason_code", "stage_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("j16_decision_classes", Q.select(Q.STAGED, "SELECT class, count(*) AS n FROM staged GROUP BY class"))
def _(spark, sf):
    return staged(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


_REACHED = """reached AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE stage_id NOT IN ('S1','S2','S?')) AS symbol_stage_or_later,
    count(*) FILTER (WHERE stage_id = 'S7' AND verdict <> 'UNDER_INVESTIGATION') AS evidence_stage,
    count(*) FILTER (WHERE stage_id IN ('S3','S5')) AS symbol_refusals,
    count(*) FILTER (WHERE stage_id IN ('S1','S2')) AS upstream_terminations FROM staged)"""


@query("a07_reached_stages", Q.select([*Q.STAGED, _REACHED], "SELECT * FROM reached"))
def _(spark, sf):
    return M.reached_stages(staged(spark, sf))


@query("a26_evaluability_gate", Q.select([*Q.STAGED, _REACHED], """
SELECT total, symbol_refusals, round(100.0 * upstream_terminations / total, 4) AS upstream_pct,
  total > 0 AND (symbol_refusals <> 0 OR round(100.0 * upstream_terminations / total, 4) < 99.0) AS evaluable,
  CASE WHEN NOT (total > 0 AND (symbol_refusals <> 0 OR round(100.0 * upstream_terminations / total, 4) < 99.0)) THEN 'NOT EVALUABLE'
    WHEN 100.0 * evidence_stage / total >= 30.0 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM reached"""))
def _(spark, sf):
    reached = M.reached_stages(staged(spark, sf))
    gate = M.evaluability(reached).join(reached.select("total", "evidence_stage"), "total")
    pct = stats.percent(F.col("evidence_stage"), F.col("total"))
    return gate.select("total", "symbol_refusals", "upstream_pct", "evaluable",
                       M.threshold_verdict(pct, 30.0, F.col("evaluable")).alias("verdict"))


@query("a08_empty_reasons", Q.select(Q.DECISIONS, """
SELECT verdict, rule_id, count(*) AS n FROM decisions WHERE reason_code IS NULL
GROUP BY GROUPING SETS ((verdict), (rule_id))"""))
def _(spark, sf):
    return M.empty_reasons(decisions(spark, sf))


@query("a04_refusals_by_reason", Q.select(Q.DECISIONS, """
SELECT reason_code, count(*) AS n FROM decisions WHERE verdict = 'UNDER_INVESTIGATION' GROUP BY reason_code"""))
def _(spark, sf):
    return M.refusals_by_reason(decisions(spark, sf))


@query("a05_cleared_with_evidence", Q.select(Q.DECISIONS, """
SELECT count(*) FILTER (WHERE verdict = 'NOT_AFFECTED' AND has_slice) AS n FROM decisions"""))
def _(spark, sf):
    records = D.decision_records(decisions(spark, sf))
    return records.agg(M.count_where(
        (F.col("verdict") == V.NOT_AFFECTED) & F.col("evidence_bundle").isNotNull(), "n"))


@query("p02_decision_records", Q.select(Q.DECISIONS, """
SELECT artifact_id, cve, component_purl, verdict, rule_id, reason_code, justification, component, statement_id,
  CASE WHEN has_slice THEN 'evidence/' || artifact_id || '/statements/' || statement_id END AS evidence_bundle
FROM decisions"""))
def _(spark, sf):
    return D.decision_records(decisions(spark, sf))


@query("p15_verdict_kinds", Q.select(Q.DECISIONS, """
SELECT CASE verdict WHEN 'UNDER_INVESTIGATION' THEN 'refusal' WHEN 'NOT_AFFECTED' THEN 'not_affected' ELSE 'affected' END AS kind,
  count(*) AS n FROM decisions GROUP BY 1"""))
def _(spark, sf):
    return decisions(spark, sf).groupBy(V.verdict_kind(F.col("verdict")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"))


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.REASON_LABELS.items())

_SUMMARIES = f"""counts AS (
  SELECT artifact_id, count(*) AS cves_in, count(*) FILTER (WHERE verdict = 'NOT_AFFECTED') AS not_affected,
    count(*) FILTER (WHERE verdict = 'AFFECTED') AS affected,
    count(*) FILTER (WHERE verdict = 'UNDER_INVESTIGATION') AS refused FROM decisions GROUP BY artifact_id),
binaries AS (
  SELECT artifact_id, count(*) AS binaries_scanned, count(*) FILTER (WHERE stripped) AS stripped,
    count(*) FILTER (WHERE static_linked) AS static_linked FROM inventories GROUP BY artifact_id),
reason_counts AS (
  SELECT artifact_id, CASE reason_code {_LABELS} ELSE reason_code END AS label, count(*) AS n FROM decisions
  WHERE verdict = 'UNDER_INVESTIGATION' GROUP BY 1, 2),
summaries AS (
  SELECT artifact_id, coalesce(binaries_scanned, 0) AS binaries_scanned, coalesce(stripped, 0) AS stripped,
    coalesce(static_linked, 0) AS static_linked, coalesce(cves_in, 0) AS cves_in,
    coalesce(not_affected, 0) AS not_affected, coalesce(affected, 0) AS affected, coalesce(refused, 0) AS refused,
    coalesce((100 * (not_affected + affected)) // nullif(cves_in, 0), 0) AS coverage_percent
  FROM counts FULL JOIN binaries USING (artifact_id))"""


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return M.scan_summaries(decisions(spark, sf), W.inventories(spark, sf))


@query("a01_scan_summaries", Q.select([*Q.DECISIONS, _SUMMARIES], """
SELECT s.*, TRUE AS success, (SELECT string_agg(label || '=' || CAST(n AS VARCHAR), ',' ORDER BY label) FROM reason_counts r
  WHERE r.artifact_id = s.artifact_id) AS refused_breakdown FROM summaries s"""))
def _(spark, sf):
    pairs = F.transform(F.map_entries("refused_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return summaries(spark, sf).withColumn("refused_breakdown", F.array_join(pairs, ",")).drop("not_affected_breakdown")


@query("a02_coverage_and_success", Q.select([*Q.DECISIONS, _SUMMARIES], """
SELECT artifact_id, coverage_percent, refused < cves_in AS decided_any FROM summaries"""))
def _(spark, sf):
    return summaries(spark, sf).select("artifact_id", "coverage_percent", (F.col("refused") < F.col("cves_in")).alias("decided_any"))


@query("a03_coverage_rollup", Q.select([*Q.DECISIONS, _SUMMARIES, W.ARTIFACTS], """
SELECT CASE WHEN grouping(class) = 1 THEN 'total' WHEN grouping(artifact_id) = 1 THEN 'class' ELSE 'artifact' END AS level,
  class, artifact_id, count(*) AS artifacts, CAST(sum(cves_in) AS BIGINT) AS cves_in, CAST(sum(not_affected) AS BIGINT) AS not_affected,
  CAST(sum(affected) AS BIGINT) AS affected, CAST(sum(refused) AS BIGINT) AS refused, CAST(sum(not_affected + affected) AS BIGINT) AS decided,
  CAST(coalesce((100 * sum(not_affected + affected)) // nullif(sum(cves_in), 0), 0) AS BIGINT) AS coverage_percent
FROM (SELECT s.*, coalesce(a.class, 'unknown') AS class FROM summaries s LEFT JOIN artifacts a USING (artifact_id))
GROUP BY ROLLUP (class, artifact_id)"""))
def _(spark, sf):
    return M.coverage_rollup(M.with_class(summaries(spark, sf), W.artifacts(spark, sf)))


@query("k02_scan_summary_documents", Q.select([*Q.DECISIONS, _SUMMARIES], """
SELECT artifact_id, to_json({'binaries_scanned': binaries_scanned, 'stripped': stripped, 'static_linked': static_linked,
  'cves_in': cves_in, 'not_affected': not_affected, 'affected': affected, 'refused': refused,
  'coverage_percent': coverage_percent, 'success': TRUE}) AS document FROM summaries"""))
def _(spark, sf):
    fields = ("binaries_scanned", "stripped", "static_linked", "cves_in", "not_affected", "affected", "refused",
              "coverage_percent", "success")
    return summaries(spark, sf).select("artifact_id", F.to_json(F.struct(*fields)).alias("document"))


@query("a11_inventory_totals", Q.select([*Q.DECISIONS, _SUMMARIES], """
SELECT CAST(sum(binaries_scanned) AS BIGINT) AS binaries, CAST(sum(stripped) AS BIGINT) AS stripped,
  CAST(sum(static_linked) AS BIGINT) AS static_linked FROM summaries"""))
def _(spark, sf):
    return summaries(spark, sf).agg(
        F.sum("binaries_scanned").alias("binaries"), F.sum("stripped").alias("stripped"),
        F.sum("static_linked").alias("static_linked"))


@query("a12_corpus_composition", Q.select([W.ARTIFACTS], """
SELECT class, count(*) AS artifacts, count(*) FILTER (WHERE status = 'present' AND sha256 IS NOT NULL) AS present_with_sha256
FROM artifacts WHERE class <> 'benchmark' GROUP BY class"""))
def _(spark, sf):
    return W.artifacts(spark, sf).where(F.col("class") != "benchmark").groupBy("class").agg(
        F.count(F.lit(1)).alias("artifacts"),
        M.count_where((F.col("status") == "present") & F.col("sha256").isNotNull(), "present_with_sha256"))


@query("p16_present_artifacts", Q.select([W.ARTIFACTS], """
SELECT artifact_id, class FROM artifacts WHERE class <> 'benchmark' AND status = 'present' AND sha256 IS NOT NULL"""))
def _(spark, sf):
    return W.artifacts(spark, sf).where(
        (F.col("class") != "benchmark") & (F.col("status") == "present") & F.col("sha256").isNotNull()
    ).select("artifact_id", "class")


_PROFILE = """count(*) AS binaries, count(*) FILTER (WHERE stripped) AS stripped, count(*) FILTER (WHERE static_linked) AS static_linked,
  count(*) FILTER (WHERE stripped AND has_dynamic) AS dynsym_only,
  round(100.0 * CAST(count(*) FILTER (WHERE stripped) AS DOUBLE) / count(*), 4) AS stripped_pct,
  round(100.0 * CAST(count(*) FILTER (WHERE static_linked) AS DOUBLE) / count(*), 4) AS static_pct,
  round(100.0 * CAST(count(*) FILTER (WHERE stripped AND has_dynamic) AS DOUBLE) / count(*), 4) AS dynsym_only_pct"""


def classed_inventories(spark: SparkSession, sf: str) -> DataFrame:
    return M.with_class(W.inventories(spark, sf), W.artifacts(spark, sf))


_CLASSED = """classed AS (SELECT i.*, a.class FROM inventories i JOIN artifacts a USING (artifact_id))"""


@query("a13_binary_profile", Q.select([W.INVENTORIES, W.ARTIFACTS, _CLASSED],
                                      f"SELECT artifact_id, class, {_PROFILE} FROM classed GROUP BY artifact_id, class"))
def _(spark, sf):
    return M.binary_profile(classed_inventories(spark, sf), ["artifact_id", "class"])


@query("i02_class_profile", Q.select([W.INVENTORIES, W.ARTIFACTS, _CLASSED],
                                     f"SELECT class, {_PROFILE} FROM classed GROUP BY class"))
def _(spark, sf):
    return M.binary_profile(classed_inventories(spark, sf), ["class"])


@query("a13_materiality_verdict", Q.select([W.INVENTORIES, W.ARTIFACTS, _CLASSED, """shares AS (
  SELECT count(*) FILTER (WHERE f) AS firmware_binaries, count(*) FILTER (WHERE c) AS container_binaries,
    100.0 * CAST(count(*) FILTER (WHERE f AND stripped) AS DOUBLE) / count(*) FILTER (WHERE f) AS fs,
    100.0 * CAST(count(*) FILTER (WHERE c AND stripped) AS DOUBLE) / count(*) FILTER (WHERE c) AS cs,
    100.0 * CAST(count(*) FILTER (WHERE f AND static_linked) AS DOUBLE) / count(*) FILTER (WHERE f) AS ft,
    100.0 * CAST(count(*) FILTER (WHERE c AND static_linked) AS DOUBLE) / count(*) FILTER (WHERE c) AS ct
  FROM (SELECT *, class = 'firmware' AS f, class IN ('oci-base','oci-app','substitute-container') AS c FROM classed))"""], """
SELECT firmware_binaries, container_binaries, round(fs - cs, 4) AS stripped_delta, round(ft - ct, 4) AS static_delta,
  CASE WHEN abs(fs - cs) < 15 AND abs(ft - ct) < 15 THEN 'not materially different'
    WHEN fs - cs <= -15 OR (ft - ct >= 15 AND fs + 10 < cs) THEN 'firmware less stripped or more static'
    WHEN fs - cs >= 15 THEN 'firmware at least as stripped' ELSE 'mixed' END AS verdict FROM shares"""))
def _(spark, sf):
    return M.materiality(classed_inventories(spark, sf))


@query("f36_wilson_interval", Q.select([*Q.STAGED], """
SELECT class, n, k, round(100.0 * k / n, 4) AS pct,
  round(greatest(0.0, c - m) * 100, 4) AS ci_low_pct, round(least(1.0, c + m) * 100, 4) AS ci_high_pct
FROM (SELECT *, (k / n + 3.8416 / (2.0 * n)) / (1 + 3.8416 / n) AS c,
    1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS m
  FROM (SELECT class, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE verdict <> 'UNDER_INVESTIGATION') AS DOUBLE) AS k
        FROM staged GROUP BY class))"""))
def _(spark, sf):
    counted = staged(spark, sf).groupBy("class").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if(V.is_decided(F.col("verdict"))).cast("double").alias("k"))
    return counted.withColumn("w", stats.wilson(F.col("k"), F.col("n"))).select("class", "n", "k", "w.*")


@query("f37_percent_helpers", Q.select([*Q.DECISIONS], """
SELECT artifact_id, coalesce((100 * count(*) FILTER (WHERE verdict <> 'UNDER_INVESTIGATION')) // nullif(count(*), 0), 0) AS coverage_percent,
  round(100.0 * CAST(count(*) FILTER (WHERE verdict <> 'UNDER_INVESTIGATION') AS DOUBLE) / count(*), 4) AS coverage_pct
FROM decisions GROUP BY artifact_id"""))
def _(spark, sf):
    done, n = F.count_if(V.is_decided(F.col("verdict"))), F.count(F.lit(1))
    return decisions(spark, sf).groupBy("artifact_id").agg(
        stats.whole_percent(done, n).alias("coverage_percent"), F.round(stats.percent(done, n), 4).alias("coverage_pct"))


RULE_TEXT = (
    "CASE rule_id WHEN 'D01' THEN 'D01 (component absent)' WHEN 'D02' THEN 'D02 (code absent)' WHEN 'D04' THEN 'D04 (code present)' "
    "ELSE 'D03 (refused: ' || CASE reason_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.REASON_WORDS.items())
    + " ELSE reason_code END || ')' END")


@query("f32_reason_and_rule_texts", Q.select(Q.DECISIONS, f"""
SELECT verdict, reason_code, CASE WHEN verdict = 'UNDER_INVESTIGATION' THEN CASE reason_code {_LABELS} ELSE reason_code END ELSE 'unspecified' END AS label,
  {RULE_TEXT} AS rule_text, count(*) AS n FROM decisions GROUP BY ALL"""))
def _(spark, sf):
    return decisions(spark, sf).groupBy(
        "verdict", "reason_code", V.reason_label(F.col("reason_code")).alias("label"),
        V.rule_words(F.col("rule_id"), F.col("reason_code")).alias("rule_text")).agg(F.count(F.lit(1)).alias("n"))


@query("a29_artifacts_with_component", Q.select(Q.DECISIONS, """
SELECT component, count(DISTINCT artifact_id) AS artifacts FROM decisions WHERE component IS NOT NULL GROUP BY component"""))
def _(spark, sf):
    return decisions(spark, sf).where(F.col("component").isNotNull()).groupBy("component").agg(
        F.countDistinct("artifact_id").alias("artifacts"))


@query("a28_dimension_counts", Q.select([W.COMPONENTS, W.ALIASES], """
SELECT (SELECT count(*) FROM components) AS components, count(*) AS aliases,
  count(*) FILTER (WHERE status = 'definitive') AS definitive_aliases FROM aliases"""))
def _(spark, sf):
    a = W.aliases(spark, sf).select(F.lit(0).alias("c"), F.lit(1).alias("a"), (F.col("status") == "definitive").alias("d"))
    c = W.components(spark, sf).select(F.lit(1).alias("c"), F.lit(0).alias("a"), F.lit(False).alias("d"))
    return a.unionByName(c).agg(
        F.sum("c").alias("components"), F.sum("a").alias("aliases"), F.count_if("d").alias("definitive_aliases"))


@query("p17_findings_mentioning_library", Q.select([W.FINDINGS], """
SELECT artifact_id, count(*) AS n FROM findings WHERE regexp_matches(lower(component_purl), 'widget|gizmo') GROUP BY artifact_id"""))
def _(spark, sf):
    return W.findings(spark, sf).where(F.lower("component_purl").rlike("widget|gizmo")).groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("n"))


def needed_names(spark, sf):
    """(artifact_id, path, needed): binary n needs the file with a third of its number."""
    n = F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint")
    return W.inventories(spark, sf).where(n > 0).select("artifact_id", "path", F.floor(n / 3).cast("string").alias("needed"))


_NEEDS = """needs AS (SELECT artifact_id, path, 'bin/' || CAST(n // 3 AS VARCHAR) AS needed
  FROM (SELECT artifact_id, path, CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) AS n FROM inventories) WHERE n > 0),
library AS (SELECT artifact_id, path FROM inventories WHERE regexp_matches(path, '^bin/[0-9]*7$')),
carriers AS (SELECT artifact_id, path FROM library
  UNION SELECT n.artifact_id, n.path FROM needs n JOIN carriers c ON n.artifact_id = c.artifact_id AND n.needed = c.path)"""


@query("a29_library_carriers", Q.select([W.FINDINGS, W.INVENTORIES, _NEEDS], """
SELECT artifact_id, path, l.path IS NOT NULL AS is_library FROM carriers LEFT JOIN library l USING (artifact_id, path)""").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, sf):
    files = W.inventories(spark, sf).select("artifact_id", "path")
    return M.library_carriers(files, needed_names(spark, sf), F.col("path").rlike("^bin/[0-9]*7$"))


@query("a29_artifacts_with_library", Q.select([W.FINDINGS, W.INVENTORIES, _NEEDS], """
SELECT f.artifact_id, CAST(count(l.path) AS BIGINT) AS library_files, CAST(count(c.path) AS BIGINT) AS carriers
FROM (SELECT DISTINCT artifact_id FROM findings WHERE regexp_matches(lower(component_purl), 'widget|gizmo')) f
LEFT JOIN carriers c ON f.artifact_id = c.artifact_id LEFT JOIN library l ON c.artifact_id = l.artifact_id AND c.path = l.path
GROUP BY f.artifact_id""").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, sf):
    files = W.inventories(spark, sf).select("artifact_id", "path")
    carriers = M.library_carriers(files, needed_names(spark, sf), F.col("path").rlike("^bin/[0-9]*7$"))
    matched = W.findings(spark, sf).where(F.lower("component_purl").rlike("widget|gizmo")).select("artifact_id").distinct()
    return M.artifacts_with_library(matched, carriers)


_LIB = "(SELECT DISTINCT artifact_id FROM inventories WHERE regexp_matches(path, '^bin/[0-9]*77$'))"


@query("j27_match_without_library_file", Q.select([W.FINDINGS, W.INVENTORIES], f"""
SELECT DISTINCT artifact_id FROM findings WHERE regexp_matches(lower(component_purl), 'widget|gizmo')
  AND artifact_id NOT IN {_LIB}"""))
def _(spark, sf):
    matched = W.findings(spark, sf).where(F.lower("component_purl").rlike("widget|gizmo")).select("artifact_id").distinct()
    files = W.inventories(spark, sf).where(F.col("path").rlike("^bin/[0-9]*77$")).select("artifact_id").distinct()
    return matched.join(files, "artifact_id", "left_anti")


@query("j28_reconciled_totals", Q.select([W.FINDINGS], """
SELECT artifact_id, a, b, CASE WHEN b IS NULL THEN 'only_a' WHEN a IS NULL THEN 'only_b' WHEN a <> b THEN 'different' ELSE 'same' END AS state,
  coalesce(b, 0) - coalesce(a, 0) AS delta
FROM (SELECT artifact_id, count(*) AS a FROM findings GROUP BY 1)
FULL JOIN (SELECT artifact_id, count(*) AS b FROM findings WHERE starts_with(component_purl, 'pkg:deb') GROUP BY 1) USING (artifact_id)"""))
def _(spark, sf):
    f = W.findings(spark, sf)
    n = F.count(F.lit(1)).alias("n")
    deb = f.where(F.col("component_purl").startswith("pkg:deb"))
    return M.reconcile(f.groupBy("artifact_id").agg(n), deb.groupBy("artifact_id").agg(n), "artifact_id", "n")


@query("v11_published_figures", Q.select([*Q.STAGED, _REACHED], """
SELECT metric, expected, actual FROM (
  SELECT 'total' AS metric, 1.0 AS expected, CAST(total AS DOUBLE) AS actual FROM reached
  UNION ALL SELECT 'symbol_refusals', CAST(symbol_refusals AS DOUBLE), CAST(symbol_refusals AS DOUBLE) FROM reached
  UNION ALL SELECT 'absent_metric', 2.0, NULL) WHERE actual IS NULL OR abs(actual - expected) >= 1e-9"""))
def _(spark, sf):
    computed = M.metric_rows(M.reached_stages(staged(spark, sf)))
    expected = spark.createDataFrame([("total", 1.0), ("absent_metric", 2.0)], "metric string, value double").unionByName(
        computed.where(F.col("metric") == "symbol_refusals"))
    return M.check_figures(expected, computed)


@query("k12_metric_document", Q.select([*Q.STAGED, _REACHED], """
SELECT to_json({'total': total, 'symbol_stage_or_later': symbol_stage_or_later, 'evidence_stage': evidence_stage,
  'symbol_refusals': symbol_refusals, 'upstream_terminations': upstream_terminations}) AS document FROM reached"""))
def _(spark, sf):
    return M.reached_stages(staged(spark, sf)).select(F.to_json(F.struct("*")).alias("document"))


# ------------------------------------------------------------- hand labels

def labelled(spark: SparkSession, sf: str) -> DataFrame:
    labels = W.table(spark, sf, "labels")
    docs = W.table(spark, sf, "documents").select("doc_id", "source")
    n = F.col("doc_id")
    refused = n % 2 == 1
    reasons = F.element_at(F.array(*[F.lit(r) for r in V.REASONS]), (n % len(V.REASONS) + 1).cast("int"))
    return labels.join(docs, "doc_id").select(
        F.concat(F.lit("real-"), n.cast("string")).alias("id"), F.col("source").alias("artifact_id"),
        F.concat(F.lit("CVE-2024-"), (n % 50 + 1000).cast("string")).alias("cve"),
        F.when(F.col("toxic") == 1, "affected").when(refused, "UNDER_INVESTIGATION").otherwise(" not_affected").alias("pipeline_verdict"),
        F.when((F.col("toxic") != 1) & refused, reasons).alias("reason_code"),
        F.when(F.col("quality") == 1, "NOT_AFFECTED").otherwise("under_investigation").alias("human_label"),
    )


_REASON_LIST = "[" + ", ".join(f"'{r}'" for r in V.REASONS) + "]"
LABELLED = f"""labelled AS (
  SELECT 'real-' || CAST(doc_id AS VARCHAR) AS id, source AS artifact_id, 'CVE-2024-' || CAST(doc_id % 50 + 1000 AS VARCHAR) AS cve,
    CASE WHEN toxic = 1 THEN 'AFFECTED' WHEN doc_id % 2 = 1 THEN 'UNDER_INVESTIGATION' ELSE 'NOT_AFFECTED' END AS pipe,
    CASE WHEN toxic <> 1 AND doc_id % 2 = 1 THEN {_REASON_LIST}[(doc_id % {len(V.REASONS)}) + 1] END AS reason_code,
    CASE WHEN quality = 1 THEN 'NOT_AFFECTED' ELSE 'UNDER_INVESTIGATION' END AS human
  FROM labels JOIN documents USING (doc_id))"""


@query("a09_label_agreement", Q.select([LABELLED], """
SELECT label_count, empty_labels, na AS not_affected_total, na AS not_affected_labeled, na > 0 AS soundness_evaluable,
  label_count = 100 AS full_evaluable, na > 0 OR label_count = 100 AS evaluable, false_na AS false_not_affected,
  agreed AS agreement_count, round(100.0 * agreed / label_count, 4) AS agreement_rate_pct
FROM (SELECT count(*) AS label_count, CAST(0 AS BIGINT) AS empty_labels, count(*) FILTER (WHERE pipe = 'NOT_AFFECTED') AS na,
  count(*) FILTER (WHERE pipe = human) AS agreed,
  count(*) FILTER (WHERE pipe = 'NOT_AFFECTED' AND human <> 'NOT_AFFECTED') AS false_na FROM labelled)"""))
def _(spark, sf):
    return M.agreement(labelled(spark, sf))


@query("a09_disagreements", Q.select([LABELLED], "SELECT id, pipe, human FROM labelled WHERE pipe <> human"))
def _(spark, sf):
    return M.disagreements(labelled(spark, sf)).select("id", "pipe", "human")


@query("a10_precision_recall_by_reason", Q.select([LABELLED], """
SELECT reason_code, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / CAST(tp + fp AS DOUBLE), 6) END AS precision,
  CASE WHEN tp + fn > 0 THEN round(tp / CAST(tp + fn AS DOUBLE), 6) END AS recall
FROM (SELECT coalesce(reason_code, '(none)') AS reason_code,
  count(*) FILTER (WHERE pipe = 'UNDER_INVESTIGATION' AND human = 'UNDER_INVESTIGATION') AS tp,
  count(*) FILTER (WHERE pipe = 'UNDER_INVESTIGATION' AND human <> 'UNDER_INVESTIGATION') AS fp,
  count(*) FILTER (WHERE pipe <> 'UNDER_INVESTIGATION' AND human = 'UNDER_INVESTIGATION') AS fn
  FROM labelled GROUP BY 1)"""))
def _(spark, sf):
    return M.precision_recall(labelled(spark, sf))


@query("a27_false_clearances_by_cve", Q.select([LABELLED], """
SELECT cve, count(*) AS n FROM labelled WHERE pipe = 'NOT_AFFECTED' AND human <> 'NOT_AFFECTED' GROUP BY cve"""))
def _(spark, sf):
    return M.false_clearances(labelled(spark, sf)).groupBy("cve").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sampling

def sampling_rows(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf).select(
        "artifact_id", "cve", "component_purl", "class", V.verdict_kind(F.col("verdict")).alias("kind"), "reason_code")


_KINDS = """sampling_rows AS (
  SELECT artifact_id, cve, component_purl, class, reason_code,
    CASE verdict WHEN 'UNDER_INVESTIGATION' THEN 'refusal' WHEN 'NOT_AFFECTED' THEN 'not_affected' ELSE 'affected' END AS kind,
    md5(concat_ws('|', '{seed}', artifact_id, cve, component_purl)) AS k FROM staged)""".replace("{seed}", str(SEED))


@query("w05_seeded_pick", Q.select([*Q.STAGED, _KINDS], """
SELECT artifact_id, cve, component_purl FROM sampling_rows WHERE class = 'firmware'
ORDER BY k, artifact_id, cve, component_purl LIMIT 40"""))
def _(spark, sf):
    return S.pick(sampling_rows(spark, sf).where(F.col("class") == "firmware"), 40, SEED).select(*S.KEY)


@query("w04_round_robin_refusals", Q.select([*Q.STAGED, _KINDS], """
SELECT artifact_id, cve, component_purl, reason_code, CAST(turn AS INTEGER) AS turn FROM (
  SELECT *, row_number() OVER (PARTITION BY reason_code ORDER BY k, artifact_id, cve, component_purl) AS turn
  FROM sampling_rows WHERE kind = 'refusal') ORDER BY turn, reason_code LIMIT 50"""))
def _(spark, sf):
    refused = sampling_rows(spark, sf).where(F.col("kind") == "refusal")
    return S.round_robin(refused, "reason_code", 50, SEED).select(*S.KEY, "reason_code", "turn")


_FIRST = """firsts AS (SELECT * FROM sampling_rows WHERE class = 'firmware' ORDER BY k, artifact_id, cve, component_purl LIMIT 40),
cleared AS (SELECT * FROM sampling_rows s WHERE kind = 'not_affected' AND k NOT IN (SELECT k FROM firsts)
  ORDER BY k LIMIT greatest(0, 20 - (SELECT count(*) FROM firsts WHERE kind = 'not_affected'))),
taken AS (SELECT * FROM firsts UNION ALL SELECT * FROM cleared),
turns AS (SELECT *, row_number() OVER (PARTITION BY reason_code ORDER BY k) AS turn FROM sampling_rows
  WHERE kind = 'refusal' AND k NOT IN (SELECT k FROM taken)),
refused AS (SELECT * EXCLUDE (turn) FROM turns ORDER BY turn, reason_code
  LIMIT greatest(0, 20 - (SELECT count(*) FROM taken WHERE kind = 'refusal'))),
taken2 AS (SELECT * FROM taken UNION ALL SELECT * FROM refused),
others AS (SELECT * FROM sampling_rows WHERE k NOT IN (SELECT k FROM taken2) ORDER BY k LIMIT greatest(0, 100 - (SELECT count(*) FROM taken2))),
sampled AS (SELECT * FROM taken2 UNION ALL SELECT * FROM others)"""


def sample(spark: SparkSession, sf: str) -> DataFrame:
    """As many rows of each quota as the tables have, as in the SQL twins."""
    return S.stratified_sample(sampling_rows(spark, sf), SEED, strict=False)


@query("o07_stratified_sample", Q.select([*Q.STAGED, _KINDS, _FIRST], """
SELECT artifact_id, cve, component_purl, class, kind, reason_code FROM sampled"""))
def _(spark, sf):
    return sample(spark, sf).drop("id")


@query("w06_sequential_ids", Q.select([*Q.STAGED, _KINDS, _FIRST], f"""
SELECT 'real-' || repeat('0', greatest(0, 3 - length(CAST(n AS VARCHAR)))) || CAST(n AS VARCHAR) AS id, artifact_id, cve, component_purl
FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED + 1}', artifact_id, cve, component_purl))) AS n FROM sampled)"""))
def _(spark, sf):
    return sample(spark, sf).select("id", *S.KEY)


@query("o08_sample_report", Q.select([*Q.STAGED, _KINDS, _FIRST], """
SELECT count(*) AS sampled, count(*) FILTER (WHERE class = 'firmware') AS firmware,
  count(*) FILTER (WHERE kind = 'not_affected') AS not_affected, count(*) FILTER (WHERE kind = 'refusal') AS refusals,
  array_to_string(list_sort(list(DISTINCT reason_code) FILTER (WHERE reason_code IS NOT NULL)), ',') AS reasons FROM sampled"""))
def _(spark, sf):
    report = S.strata_report(sample(spark, sf))
    return report.withColumn("reasons", F.array_join("reasons", ","))
