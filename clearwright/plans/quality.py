"""Queries of pairing losses, patches and data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwright.functions import verdict as V
from clearwright.operators import decide as D
from clearwright.operators import pairing as PA
from clearwright.operators import patches as PT
from clearwright.operators import quality as QA
from clearwright.plans import sqltext as Q
from clearwright.plans import views as W
from clearwright.plans.decisions import decisions
from clearwright.plans.registry import query

# ------------------------------------------------------------------ pairing
# An event is one scanner hit: user mod 20 is the image, the type is the cell.

_MODELS = ("deb", "apk", "rpm")
_BASE = {"view": "view", "click": "view", "purchase": "view", "signup": "signup", "error": "signup"}


def hits(spark, sf):
    e = W.table(spark, sf, "events")
    image = F.col("user_id") % 20
    return e.select(
        image.alias("image_id"), F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (image % 3 + 1).cast("int")).alias("advisory_model"),
        F.col("event_type").alias("cell"), F.concat(F.lit("CVE-"), (F.col("event_id") % F.when(F.col("event_type") == "error", 60).otherwise(100)).cast("string")).alias("vulnerability"),
        F.concat(F.lit("pkg"), (F.col("event_id") % 9).cast("string")).alias("name"),
        F.array(F.concat(F.lit("pkg"), (F.col("event_id") % 5).cast("string"))).alias("upstreams"))


_HITS = """hits AS (
  SELECT user_id % 20 AS image_id, ['deb','apk','rpm'][((user_id % 20) % 3) + 1] AS advisory_model, event_type AS cell,
    'CVE-' || CAST(event_id % CASE WHEN event_type = 'error' THEN 60 ELSE 100 END AS VARCHAR) AS vulnerability,
    'pkg' || CAST(event_id % 9 AS VARCHAR) AS name, 'pkg' || CAST(event_id % 5 AS VARCHAR) AS source FROM events),
cells AS (
  SELECT image_id, advisory_model, cell, count(DISTINCT vulnerability) AS unique_vulns, count(*) AS packages_observed,
    count(*) FILTER (WHERE name <> source) AS src_ne_binary FROM hits GROUP BY ALL)"""
_BASE_SQL = "CASE cell " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _BASE.items()) + " END"
_LOSSES = f"""losses AS (
  SELECT c.*, b.cell AS baseline_cell, b.unique_vulns AS baseline_vulns, b.src_ne_binary AS baseline_src_ne_binary,
    c.unique_vulns - b.unique_vulns AS vuln_delta,
    CASE WHEN b.unique_vulns > 0 THEN round(100.0 * (b.unique_vulns - c.unique_vulns) / b.unique_vulns, 1) WHEN c.unique_vulns = 0 THEN 0.0 END AS vuln_loss_pct,
    CASE WHEN c.cell <> b.cell AND b.unique_vulns > 0 AND (c.unique_vulns = 0 OR b.unique_vulns - c.unique_vulns >= 5
      OR round(100.0 * (b.unique_vulns - c.unique_vulns) / b.unique_vulns, 1) >= 10.0) THEN 'yes' ELSE 'no' END AS material_loss
  FROM (SELECT *, {_BASE_SQL} AS bc FROM cells) c JOIN cells b ON c.image_id = b.image_id AND c.bc = b.cell)"""


def cells(spark, sf):
    keys = ["image_id", "advisory_model", "cell"]
    h = hits(spark, sf)
    return PA.distinct_counts(h, keys).join(PA.package_counts(h, keys), keys)


def losses(spark, sf):
    return PA.pairing_losses(cells(spark, sf), _BASE)


@query("a15_pairing_cells", Q.select([_HITS], "SELECT * FROM cells"))
def _(spark, sf):
    return cells(spark, sf)


@query("j19_pairing_against_baseline", Q.select([_HITS, _LOSSES], "SELECT image_id, cell, baseline_cell, unique_vulns, baseline_vulns FROM losses"))
def _(spark, sf):
    return losses(spark, sf).select("image_id", "cell", "baseline_cell", "unique_vulns", "baseline_vulns")


@query("a16_pairing_losses", Q.select([_HITS, _LOSSES], "SELECT image_id, cell, vuln_delta, vuln_loss_pct, material_loss FROM losses"))
def _(spark, sf):
    return losses(spark, sf).select("image_id", "cell", "vuln_delta", "vuln_loss_pct", "material_loss")


@query("k10_pairing_matrix_rows", Q.select([_HITS, _LOSSES], """
SELECT image_id, advisory_model, cell, unique_vulns, src_ne_binary, baseline_cell, baseline_vulns, baseline_src_ne_binary, vuln_delta, vuln_loss_pct, material_loss FROM losses"""))
def _(spark, sf):
    return losses(spark, sf)


@query("a17_loss_by_model", Q.select([_HITS, _LOSSES], """
SELECT advisory_model, cell, count(*) AS images, count(*) FILTER (WHERE material_loss = 'yes') AS material,
  round(coalesce(avg(vuln_loss_pct) FILTER (WHERE baseline_vulns > 0), 0.0), 1) AS mean_loss_pct, round(avg(src_ne_binary), 1) AS mean_src_ne_binary,
  round(avg(baseline_src_ne_binary), 1) AS mean_baseline_src_ne_binary
FROM losses WHERE cell <> baseline_cell GROUP BY advisory_model, cell"""))
def _(spark, sf):
    return PA.loss_by_model(losses(spark, sf))


@query("a18_class_verdict", Q.select([_HITS, _LOSSES], """
SELECT count(DISTINCT baseline_cell) AS consumers, count(DISTINCT cell) AS cells,
  CASE WHEN count(DISTINCT baseline_cell) > 1 THEN 'multiple consumers' WHEN count(DISTINCT baseline_cell) = 1 THEN 'single consumer' ELSE 'none' END AS verdict
FROM losses WHERE material_loss = 'yes'"""))
def _(spark, sf):
    return PA.class_verdict(losses(spark, sf))


_SCANS = [W.FINDINGS, """new_ids AS (
  SELECT DISTINCT cve AS vulnerability, coalesce(nullif(regexp_extract(component_purl, '^pkg:([^/]*)', 1), ''), 'unknown') AS purl_type
  FROM findings WHERE cve NOT IN (SELECT cve FROM findings WHERE artifact_id IN ('src1', 'src2', 'src3')))"""]


def surfaced(spark, sf):
    f = W.findings(spark, sf).select("artifact_id", F.col("cve").alias("vulnerability"), F.col("component_purl").alias("purl_text"))
    return PA.newly_surfaced(f.where(F.col("artifact_id").isin("src1", "src2", "src3")), f)


@query("j20_newly_surfaced_ids", Q.select(_SCANS, "SELECT * FROM new_ids"))
def _(spark, sf):
    return surfaced(spark, sf)


@query("a19_surfaced_ids_by_class", Q.select(_SCANS, """
SELECT CASE WHEN n > 1 THEN 'mixed' WHEN o IN ('deb','npm') THEN o || '_only' ELSE 'other_only' END AS kind, count(*) AS ids
FROM (SELECT vulnerability, count(*) AS n, min(purl_type) AS o FROM new_ids GROUP BY vulnerability) GROUP BY 1"""))
def _(spark, sf):
    return PA.surfaced_classes(surfaced(spark, sf))


@query("u03_after_without_before", Q.select([W.FINDINGS], """
SELECT DISTINCT cve FROM findings WHERE artifact_id = 'src5' EXCEPT SELECT cve FROM findings WHERE artifact_id <> 'src5'"""))
def _(spark, sf):
    f = W.findings(spark, sf)
    return f.where(F.col("artifact_id") == "src5").select("cve").subtract(f.where(F.col("artifact_id") != "src5").select("cve"))


@query("a32_enrichment_effect", Q.select([_HITS], """
SELECT image_id, b AS before, a AS after, a - b AS hidden, CASE WHEN a = 0 THEN 0.0 ELSE round(100.0 * (a - b) / a, 1) END AS hidden_pct, a - b > 0 AS affected
FROM (SELECT image_id, count(DISTINCT vulnerability) FILTER (WHERE cell = 'error') AS b, count(DISTINCT vulnerability) FILTER (WHERE cell = 'view') AS a FROM hits
  WHERE cell IN ('error', 'view') GROUP BY image_id)"""))
def _(spark, sf):
    phases = hits(spark, sf).withColumnRenamed("cell", "phase").where(F.col("phase").isin("error", "view"))
    return PA.enrichment_effect(phases, "error", "view")


@query("a31_sbom_counts_by_format", Q.select([_HITS], """
SELECT image_id, cell AS format, count(*) AS packages, count(DISTINCT name) AS purls FROM hits GROUP BY image_id, cell"""))
def _(spark, sf):
    h = hits(spark, sf).withColumnRenamed("cell", "format")
    return h.groupBy("image_id", "format").agg(F.count(F.lit(1)).alias("packages"), F.countDistinct("name").alias("purls"))


# ------------------------------------------------------------------ patches

_PATCH = r"""concat('diff --git a/x b/x\n--- a/src/', p_type, '.c\t2020\n+++ b/src/', p_type, '.c\n@@ -', p_size, ',3 +', p_size + 1, ',4 @@ int f(void)\n ctx\n-old line\n+new one\n+new two\n\\ No newline\n ctx\n+tail\n',
  '--- /dev/null\n+++ b/new.h\n@@ -0,0 +1 @@\n+x\n--- a/gone.c\n+++ /dev/null\n@@ -7 +0,0 @@\n-y')"""
_CHANGED = """changed AS (
  SELECT p_partkey AS patch_id, c.path, c.side, CAST(c.line AS INTEGER) AS line FROM part, LATERAL (VALUES
    ('src/' || p_type || '.c', 'old', p_size + 1), ('src/' || p_type || '.c', 'new', p_size + 2), ('src/' || p_type || '.c', 'new', p_size + 3),
    ('src/' || p_type || '.c', 'new', p_size + 5), ('new.h', 'new', 1), ('gone.c', 'old', 7)) c(path, side, line))"""


def changed(spark, sf):
    return PT.changed_lines(W.table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id"), F.expr(_PATCH).alias("patch")))


@query("s26_changed_lines", Q.select([_CHANGED], "SELECT * FROM changed"))
def _(spark, sf):
    return changed(spark, sf)


@query("w07_line_counters", Q.select([_CHANGED], "SELECT side, sum(line)::BIGINT AS total, count(*) AS n FROM changed GROUP BY side"))
def _(spark, sf):
    return changed(spark, sf).groupBy("side").agg(F.sum("line").alias("total"), F.count(F.lit(1)).alias("n"))


# A part is a patch: its lineitems are changed lines, and it has two functions per file.
_SPANS = """line_rows AS (
  SELECT DISTINCT p_partkey AS patch_id, p_type AS path, CAST(l_quantity * 40 AS INTEGER) AS line FROM line_parts),
span_rows AS (
  SELECT p_partkey AS patch_id, p_type AS path, f.function, f.start_line, f.end_line FROM part, LATERAL (VALUES
    ('init_' || CAST(p_size AS VARCHAR), p_size * 20, p_size * 20 + 300), ('free_' || CAST(p_size AS VARCHAR), p_size * 20 + 200, p_size * 20 + 900)) f(function, start_line, end_line))"""


def line_rows(spark, sf):
    return W._line_parts(spark, sf).select(
        F.col("p_partkey").alias("patch_id"), F.col("p_type").alias("path"), F.lit("new").alias("side"),
        (F.col("l_quantity") * 40).cast("int").alias("line")).distinct()


def span_rows(spark, sf):
    n, start = F.col("p_size").cast("string"), F.col("p_size") * 20
    functions = F.array(
        F.struct(F.concat(F.lit("init_"), n).alias("function"), start.alias("start_line"), (start + 300).alias("end_line")),
        F.struct(F.concat(F.lit("free_"), n).alias("function"), (start + 200).alias("start_line"), (start + 900).alias("end_line")))
    return W.table(spark, sf, "part").select(
        F.col("p_partkey").alias("patch_id"), F.col("p_type").alias("path"), F.lit("new").alias("side"), F.inline(functions))


@query("j21_lines_in_functions", Q.select([W.LINE_PARTS, _SPANS], """
SELECT l.patch_id, l.path, l.line, s.function FROM line_rows l JOIN span_rows s ON l.patch_id = s.patch_id AND l.path = s.path AND l.line BETWEEN s.start_line AND s.end_line"""))
def _(spark, sf):
    return PT.enclosing_functions(line_rows(spark, sf), span_rows(spark, sf)).select("patch_id", "path", "line", "function")


@query("a30_touched_functions", Q.select([W.LINE_PARTS, _SPANS], """
SELECT DISTINCT 'CVE-2024-' || CAST(1000 + l.patch_id % 50 AS VARCHAR) AS cve, s.function FROM line_rows l JOIN span_rows s ON l.patch_id = s.patch_id AND l.path = s.path AND l.line BETWEEN s.start_line AND s.end_line"""))
def _(spark, sf):
    fixes = line_rows(spark, sf).select("patch_id").distinct().withColumn(
        "cve", F.concat(F.lit("CVE-2024-"), (1000 + F.col("patch_id") % 50).cast("string")))
    return PT.touched_functions(line_rows(spark, sf), span_rows(spark, sf), fixes)


# ------------------------------------------------------------------ quality

_PROVENANCE = """named_struct('upstream_fix_commit', CASE WHEN p_size % 11 = 0 THEN 'ftp://x' WHEN p_size % 11 = 1 THEN 'http://x' ELSE 'https://example.org/c' END,
  'derivation', CASE WHEN p_size % 13 = 0 THEN 'guess' ELSE 'manual' END, 'reviewed_by', CASE WHEN p_size % 7 = 0 THEN ' ' ELSE 'r' END,
  'reviewed_at', CASE WHEN p_size % 17 = 0 THEN '2024-02-30' ELSE '2024-02-28' END)"""
_ENTRY = f"""named_struct('component', replace(p_name, ' ', '-'), 'ecosystem', 'native', 'cve', CASE WHEN p_size % 5 = 0 THEN 'cve-1' ELSE concat('CVE-2024-', 10000 + p_partkey) END,
  'affected_versions', CASE WHEN p_size % 6 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array('<2') END, 'manifest_version', CASE WHEN p_size % 9 = 0 THEN '' ELSE '1' END,
  'source_file', CASE WHEN p_size % 10 = 0 THEN 'components/x' ELSE 'candidates/x' END, 'reviewed_by', CASE WHEN p_size % 8 = 0 THEN CAST(NULL AS STRING) ELSE 'ann' END,
  'reviewed_at', CASE WHEN p_size % 12 = 0 THEN 'soon' ELSE '2024-05-05' END,
  'vulnerable_symbols', CASE WHEN p_size % 19 = 0 THEN CAST(array() AS ARRAY<STRUCT<name: STRING, confidence: STRING, provenance: STRUCT<upstream_fix_commit: STRING, derivation: STRING, reviewed_by: STRING, reviewed_at: STRING>>>)
    ELSE array(named_struct('name', CASE WHEN p_size % 14 = 0 THEN '' ELSE 'f' END, 'confidence', CASE WHEN p_size % 3 = 0 THEN 'definitive' WHEN p_size % 3 = 1 THEN 'probable' ELSE 'maybe' END, 'provenance', {_PROVENANCE})) END)"""


def part_entries(spark, sf):
    return W.table(spark, sf, "part").select("p_partkey", "p_size", F.expr(_ENTRY).alias("e")).select("p_partkey", "p_size", "e.*")


def _rules_sql(rules, source="part"):
    """Counts per rule from boolean conditions."""
    parts = [f"SELECT '{rule}' AS rule, count(*) AS n FROM {source} WHERE {cond}" for rule, cond in rules.items()]
    return "SELECT rule, n FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


def _counted(v):
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_HAS = "p_size % 19 <> 0 AND "


@query("v01_manifest_entry_rules", _rules_sql({
    "cve_shape": "p_size % 5 = 0", "affected_versions_required": "p_size % 6 = 0", "manifest_version_required": "p_size % 9 = 0",
    "symbols_required": "p_size % 19 = 0", "symbol_name_required": _HAS + "p_size % 14 = 0", "confidence_enum": _HAS + "p_size % 3 = 2",
    "fix_url": _HAS + "p_size % 11 = 0", "derivation_enum": _HAS + "p_size % 13 = 0", "reviewer_required": _HAS + "p_size % 7 = 0",
    "review_date": _HAS + "p_size % 17 = 0"}))
def _(spark, sf):
    return _counted(QA.manifest_entries(part_entries(spark, sf)))


@query("v01_manifest_component_rules", _rules_sql({
    "name_required": "p_size % 5 = 0", "purls_required": "p_size % 3 = 0", "identity_symbols_required": "p_size % 2 = 0"}))
def _(spark, sf):
    rows = W.table(spark, sf, "part").select(
        F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.lit("native").alias("ecosystem"),
        F.when(F.col("p_size") % 3 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("pkg:a/b"))).alias("purls"),
        F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("s"))).alias("identity_symbols"),
        F.lit(None).cast("array<string>").alias("identity_strings"))
    return _counted(QA.manifest_components(rows))


@query("v02_identity_patterns", Q.select([W.COMPONENTS, W.BENCHMARK_WORDS, W.IDENTITY_STRINGS], """
SELECT component AS key, 'pattern_compiles' AS rule FROM (SELECT DISTINCT component, position FROM identity_strings WHERE position % 5 = 0)"""))
def _(spark, sf):
    broken = F.when(F.col("position") % 5 == 0, F.concat(F.col("position").cast("string"), F.lit("("))).otherwise(F.col("pattern"))
    return QA.identity_patterns(W.identity_strings(spark, sf).withColumn("pattern", broken)).select("key", "rule")


_DEF = "p_size % 2 = 0 AND "


@query("v03_alias_rules", _rules_sql({
    "status_enum": "p_size % 9 = 1 AND p_size % 2 = 1", "artifact_sha256": _DEF + "p_size % 3 = 0", "distro_required": _DEF + "p_size % 5 = 0",
    "verified_at": _DEF + "p_size % 7 = 0", "identity_symbols_verified": _DEF + "p_size % 11 = 0",
    "extraction_method_denied": _DEF + "p_size % 4 = 2 AND p_size % 3 = 1", "extraction_method_allowed": _DEF + "p_size % 4 = 2 AND p_size % 3 = 2"}) + """
UNION ALL SELECT 'source_name_unique', count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)""")
def _(spark, sf):
    n = F.col("p_size")
    text = F.lit("x")
    method = F.when(n % 4 == 0, "dpkg-deb-extract").when(n % 3 == 1, "changelog").when(n % 3 == 2, "other").otherwise("apk-extract")
    rows = W.table(spark, sf, "part").select(
        F.col("p_name").alias("source_name"), F.lit("pkg:generic/c").alias("component"),
        F.when(n % 2 == 0, "definitive").when(n % 9 == 1, "sure").otherwise("probable").alias("status"),
        F.struct(
            F.when(n % 3 == 0, "zz").otherwise(F.upper(F.sha2("p_name", 256))).alias("artifact_sha256"), F.when(n % 5 == 0, "").otherwise("debian").alias("distro"),
            text.alias("package_name"), text.alias("package_version"), F.when(n % 7 == 0, "May").otherwise("2024-01-01").alias("verified_at"),
            text.alias("binary_path"), F.when(n % 11 == 0, F.array(F.lit(" "))).otherwise(F.array(text)).alias("identity_symbols_verified"),
            method.alias("extraction_method"), text.alias("reviewed_by")).alias("provenance"))
    return _counted(QA.aliases(rows))


@query("v04_catalogue_rules", Q.select([W.ARTIFACTS], """
SELECT artifact_id AS key, 'hash_iff_present' AS rule FROM artifacts WHERE (status = 'present') <> (sha256 IS NOT NULL)
UNION ALL SELECT artifact_id, 'source_url_required' FROM artifacts WHERE source_url IS NULL
UNION ALL SELECT '*', 'min_artifacts' FROM (SELECT count(*) AS n FROM artifacts) WHERE n < 40
UNION ALL SELECT '*', 'min_firmware' FROM (SELECT count(*) AS n FROM artifacts WHERE class = 'firmware') WHERE n < 10"""))
def _(spark, sf):
    return QA.catalogue(W.artifacts(spark, sf)).select("key", "rule")


@query("v05_emit_input_rules", _rules_sql({
    "bundle_id_required": "o_orderkey % 7 = 0", "timestamp_rfc3339": "o_orderkey % 5 = 0", "cve_required": "o_orderkey % 3 = 0"}, "orders"))
def _(spark, sf):
    k = F.col("o_orderkey")
    rows = W.table(spark, sf, "orders").select(
        k.alias("artifact_id"), F.when(k % 7 != 0, "b").alias("bundle_id"), F.lit("h").alias("artifact_sha256"),
        F.when(k % 5 == 0, "2026-13-01T00:00:00Z").otherwise("2026-01-01T00:00:00Z").alias("timestamp"),
        F.when(k % 3 == 0, "").otherwise("CVE-1").alias("cve"), F.lit("pkg:a/b").alias("component_purl"))
    return _counted(QA.emit_inputs(rows))


@query("v06_promotion_gate", _rules_sql({
    "reviewed_by_required": "p_size % 8 = 0", "reviewed_at_date": "p_size % 12 = 0", "already_published": "p_size % 10 = 0", "symbols_required": "p_size % 19 = 0",
    "symbol_name_required": _HAS + "p_size % 14 = 0", "manifest_version_required": "p_size % 9 = 0"}))
def _(spark, sf):
    return _counted(QA.promotion(part_entries(spark, sf)))


@query("k15_promoted_entries", """
SELECT p_partkey, 'definitive' AS confidence, 'ann' AS reviewed_by FROM part WHERE p_size % 8 <> 0 AND p_size % 12 <> 0 AND p_size % 10 <> 0 AND p_size % 19 <> 0 AND p_size % 14 <> 0 AND p_size % 9 <> 0
  AND replace(p_name, ' ', '-') || '/' || CASE WHEN p_size % 5 = 0 THEN 'cve-1' ELSE 'CVE' || CAST(p_partkey AS VARCHAR) END NOT IN (
    SELECT replace(p_name, ' ', '-') || '/' || CASE WHEN p_size % 5 = 0 THEN 'cve-1' ELSE 'CVE' || CAST(p_partkey AS VARCHAR) END FROM part
    WHERE NOT (p_size % 8 <> 0 AND p_size % 12 <> 0 AND p_size % 10 <> 0 AND p_size % 19 <> 0 AND p_size % 14 <> 0 AND p_size % 9 <> 0))""")
def _(spark, sf):
    s = F.col("vulnerable_symbols")[0]
    return QA.promote(part_entries(spark, sf)).select(
        "p_partkey", s["confidence"].alias("confidence"), s["provenance"]["reviewed_by"].alias("reviewed_by"))


@query("k14_candidate_entries", """
SELECT p_partkey, CASE WHEN p_size % 19 <> 0 THEN 'probable' END AS confidence, CAST(NULL AS VARCHAR) AS reviewed_by FROM part""")
def _(spark, sf):
    rows = part_entries(spark, sf).withColumn("s", QA.forced_probable(F.col("vulnerable_symbols")))
    first = F.try_element_at("s", F.lit(1))
    return rows.select("p_partkey", first["confidence"].alias("confidence"), first["provenance"]["reviewed_by"].alias("reviewed_by"))


@query("v07_proposal_gate", _rules_sql({
    "cve_shape": "p_size % 5 = 0", "fix_commit_url": "p_size % 4 = 0", "affected_versions_required": "p_size % 6 = 0", "fixture_or_recipe": "p_size % 3 = 0"}))
def _(spark, sf):
    return _counted(QA.proposals(proposal_rows(spark, sf)))


def proposal_rows(spark, sf):
    n = F.col("p_size")
    return part_entries(spark, sf).select(
        "p_partkey", "component", "cve", "affected_versions", F.when(n % 4 == 0, "git://x").otherwise("https://x").alias("fix_commit"), F.lit("ok").alias("verification"),
        F.when(n % 3 == 1, "f").alias("fixture"), F.when(n % 3 == 2, "r").otherwise(" ").alias("build_recipe"))


@query("j26_proposals_without_component", Q.select([W.COMPONENTS], """
SELECT replace(p_name, ' ', '-') AS component, count(*) AS n FROM part WHERE replace(p_name, ' ', '-') NOT IN (SELECT component FROM components) GROUP BY 1"""))
def _(spark, sf):
    shells = W.components(spark, sf).select(F.col("component").alias("name"))
    lost = QA.proposals_without_component(proposal_rows(spark, sf), shells)
    return lost.groupBy(F.substring_index("key", "/", 1).alias("component")).agg(F.count(F.lit(1)).alias("n"))


@query("v08_derive_input_rules", _rules_sql({"repo_required": "p_size % 4 = 0", "cve_required": "p_size % 3 = 0", "affected_versions_required": "p_size % 6 = 0"}))
def _(spark, sf):
    return _counted(QA.derive_inputs(derive_rows(spark, sf)))


def derive_rows(spark, sf):
    n = F.col("p_size")
    some = F.array(F.lit("x"))
    return part_entries(spark, sf).select(
        "component", "ecosystem", F.when(n % 4 == 0, "").otherwise("https://r").alias("repo"), some.alias("purls"), some.alias("identity_symbols"),
        F.when(n % 3 != 0, F.col("cve")).alias("cve"), F.lit("abc").alias("fix_commit"), "affected_versions")


@query("s27_valid_derive_inputs", """
SELECT component, count(*) AS n FROM (SELECT replace(p_name, ' ', '-') AS component FROM part WHERE p_size % 4 <> 0 AND p_size % 3 <> 0 AND p_size % 6 <> 0) GROUP BY component""")
def _(spark, sf):
    return QA.valid_derive_inputs(derive_rows(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query("v09_candidate_gate", _rules_sql({
    "no_definitive": _HAS + "p_size % 3 = 0", "no_reviewer": "p_size % 19 <> 0", "https_fix_url": _HAS + "p_size % 11 IN (0, 1)",
    "some_probable": "NOT (p_size % 19 <> 0 AND p_size % 3 = 1)"}))
def _(spark, sf):
    return _counted(QA.candidates(part_entries(spark, sf)))


def damaged_decisions(spark, sf):
    """Decisions of which some were spoilt on their way: a lost justification or reason, a reason where none belongs, an odd verdict."""
    n = F.length("component_purl") % 12
    return decisions(spark, sf).select(
        "artifact_id", "cve", "component_purl",
        F.when(n == 1, "MAYBE").otherwise(F.col("verdict")).alias("verdict"),
        F.when(n == 2, F.lit(" ")).when(n == 3, V.FORBIDDEN_JUSTIFICATIONS[0]).otherwise(F.col("justification")).alias("justification"),
        F.when(n == 4, F.lit(None)).when(n == 5, F.lit("why")).otherwise(F.col("reason_code")).alias("reason_code"))


_DAMAGED = f"""damaged AS (
  SELECT artifact_id, cve, component_purl, CASE WHEN length(component_purl) % 12 = 1 THEN 'MAYBE' ELSE verdict END AS verdict,
    CASE length(component_purl) % 12 WHEN 2 THEN NULL WHEN 3 THEN '{V.FORBIDDEN_JUSTIFICATIONS[0]}' ELSE justification END AS justification,
    CASE length(component_purl) % 12 WHEN 4 THEN NULL WHEN 5 THEN 'why' ELSE reason_code END AS reason_code FROM decisions)"""


@query("v10_decision_invariants", Q.select([*Q.DECISIONS, _DAMAGED], f"""
SELECT artifact_id || '|' || cve || '|' || component_purl AS key, rule FROM (
  SELECT *, unnest(list_filter([
    CASE WHEN verdict = 'MAYBE' THEN 'verdict_enum' END,
    CASE WHEN verdict = 'NOT_AFFECTED' AND justification IS NULL THEN 'cleared_has_justification' END,
    CASE WHEN verdict = 'UNDER_INVESTIGATION' AND reason_code IS NULL THEN 'refusal_has_reason' END,
    CASE WHEN verdict = 'AFFECTED' AND (reason_code IS NOT NULL OR justification IS NOT NULL) THEN 'affected_has_neither' END,
    CASE WHEN justification = '{V.FORBIDDEN_JUSTIFICATIONS[0]}' THEN 'forbidden_justification' END], lambda x: x IS NOT NULL)) AS rule FROM damaged)"""))
def _(spark, sf):
    return QA.decisions(damaged_decisions(spark, sf)).select("key", "rule")


@query("d05_forbidden_justifications", Q.select([*Q.DECISIONS, _DAMAGED], f"""
SELECT artifact_id, cve, component_purl FROM damaged WHERE justification = '{V.FORBIDDEN_JUSTIFICATIONS[0]}'"""))
def _(spark, sf):
    return D.forbidden_justifications(damaged_decisions(spark, sf)).select("artifact_id", "cve", "component_purl")


_COVERAGE = """SELECT 'native' AS ecosystem, replace(p_name, ' ', '-') {0} AS component, count(*) FILTER (WHERE p_size % 19 <> 0 AND p_size % 3 = 0) AS definitive,
  count(*) FILTER (WHERE p_size % 19 <> 0 AND p_size % 3 <> 0) AS probable, count(*) FILTER (WHERE p_size % 19 = 0) AS none FROM part GROUP BY 1, 2"""


@query("a14_manifest_coverage", _COVERAGE.format("") + " UNION ALL " + _COVERAGE.format("|| ' (candidate)'"))
def _(spark, sf):
    rows = part_entries(spark, sf)
    return QA.manifest_coverage(rows).unionByName(QA.manifest_coverage(rows, " (candidate)"))


@query("k13_coverage_detail", """
SELECT p_partkey, CASE WHEN p_size % 19 = 0 THEN 'none' WHEN p_size % 3 = 0 THEN 'definitive' ELSE 'probable' END AS class FROM part""")
def _(spark, sf):
    from clearwright.functions.verdict import confidence_class

    return part_entries(spark, sf).select("p_partkey", confidence_class(F.col("vulnerable_symbols")).alias("class"))
