"""Queries over documents: each document is built by Spark from a table row, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwright.functions import verdict as V
from clearwright.operators import audit as A
from clearwright.operators.decide import normalize_findings
from clearwright.plans import sqltext as Q
from clearwright.plans import views as W
from clearwright.plans.registry import query
from clearwright.functions import purl as P
from clearwright.sources import findings as SF
from clearwright.sources import sbom as SB
from clearwright.sources import vex as SV

_HIT = "named_struct('vulnerability', named_struct('id', cve), 'artifact', named_struct('purl', component_purl, 'name', 'n'))"
_GRYPE_DOC = f"to_json(named_struct('matches', array({_HIT}, {_HIT}), 'descriptor', named_struct('name', 'grype')))"
_TRIVY_DOC = ("to_json(named_struct('Results', array(named_struct('Target', 't', 'Vulnerabilities', array("
              "named_struct('VulnerabilityID', cve, 'PkgIdentifier', named_struct('PURL', if(scan_id % 2 = 0, component_purl, '')), "
              "'PkgName', concat('pkg', scan_id)))))))")
_TOOL_DOC = ("to_json(array(named_struct('cve', cve, 'purl', if(scan_id % 2 = 0, component_purl, null), 'name', concat('pkg', scan_id))))")


def scan_documents(spark, sf, body):
    return W.raw_findings(spark, sf).select(F.col("artifact_id").alias("doc_id"), F.expr(body).alias("content"))


@query("s01_grype_findings", Q.select([W.FINDINGS], "SELECT * FROM findings"))
def _(spark, sf):
    return normalize_findings(SF.load_findings(scan_documents(spark, sf, _GRYPE_DOC)))


_NAMED = """SELECT DISTINCT artifact_id, upper(trim(cve)) AS cve,
  CASE WHEN scan_id % 2 = 0 THEN component_purl ELSE 'pkg:generic/pkg' || CAST(scan_id AS VARCHAR) END AS component_purl FROM raw_findings"""


@query("s02_trivy_findings", Q.select([W.RAW_FINDINGS], _NAMED))
def _(spark, sf):
    return normalize_findings(SF.load_findings(scan_documents(spark, sf, _TRIVY_DOC)))


@query("s03_cve_bin_tool_findings", Q.select([W.RAW_FINDINGS], _NAMED))
def _(spark, sf):
    return normalize_findings(SF.load_findings(scan_documents(spark, sf, _TOOL_DOC)))


@query("s04_mixed_scan_formats", Q.select([W.RAW_FINDINGS], """
SELECT format, count(*) AS n FROM (
  SELECT CASE scan_id % 4 WHEN 0 THEN 'grype' WHEN 1 THEN 'trivy' WHEN 2 THEN 'cve-bin-tool' ELSE 'unrecognized' END AS format,
    unnest(range(CASE WHEN scan_id % 4 = 0 THEN 2 ELSE 1 END)) FROM raw_findings) GROUP BY format"""))
def _(spark, sf):
    body = f"CASE scan_id % 4 WHEN 0 THEN {_GRYPE_DOC} WHEN 1 THEN {_TRIVY_DOC} WHEN 2 THEN {_TOOL_DOC} ELSE '{{\"other\": 1}}' END"
    docs = scan_documents(spark, sf, body)
    known = SF.load_findings(docs).select("format")
    other = SF.unrecognized(docs).select(F.lit("unrecognized").alias("format"))
    return known.unionByName(other).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


_OSV_LINE = ("CASE WHEN p_partkey % 10 = 9 THEN '{bad json' ELSE to_json(named_struct('id', concat(' osv-', p_size % 4), 'affected', array("
             "named_struct('package', named_struct('ecosystem', CASE p_partkey % 3 WHEN 0 THEN 'Debian' WHEN 1 THEN 'npm' ELSE 'generic' END, "
             "'name', concat(if(p_partkey % 3 = 1, '@acme/', ''), replace(p_name, ' ', '-'))))))) END")
_OSV_KEYS = """osv_keys AS (
  SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'deb/' WHEN 1 THEN 'npm/@acme/' ELSE 'generic/' END || replace(p_name, ' ', '-') AS key,
    'OSV-' || CAST(p_size % 4 AS VARCHAR) AS vulnerability FROM part WHERE p_partkey % 10 <> 9)"""


def osv_lines(spark, sf):
    return W.table(spark, sf, "part").select(F.expr(_OSV_LINE).alias("value"))


@query("s05_osv_keys", Q.select([_OSV_KEYS], "SELECT * FROM osv_keys"))
def _(spark, sf):
    return SF.osv_keys(osv_lines(spark, sf))


_SBOM_TEXT = [W.LINE_PARTS, f"""sbom_lines AS (
  SELECT l_orderkey, l_linenumber, p_size, p_partkey, CASE l_linenumber % 3
    WHEN 0 THEN 'pkg:generic/' || {W._NAME} WHEN 1 THEN 'pkg:deb/debian/' || {W._NAME} || '@' || {W._VERSION}
    ELSE 'pkg:npm/%40acme/' || {W._NAME} || '@' || {W._VERSION} END AS purl_text FROM line_parts)""",
    Q.parsed("sbom_lines", "purl_text", "sbom_parsed")]


def sbom_lines(spark, sf):
    text = (f"CASE l_linenumber % 3 WHEN 0 THEN 'pkg:generic/' || {W._NAME} WHEN 1 THEN 'pkg:deb/debian/' || {W._NAME} || '@' || {W._VERSION} "
            f"ELSE 'pkg:npm/%40acme/' || {W._NAME} || '@' || {W._VERSION} END")
    return W._line_parts(spark, sf).select("l_orderkey", "l_linenumber", "p_size", "p_partkey", F.expr(text).alias("purl_text"))


@query("s28_osv_findings", Q.select([*_SBOM_TEXT, _OSV_KEYS], """
SELECT DISTINCT 'sbom' || CAST(l_orderkey AS VARCHAR) AS artifact_id, vulnerability AS cve, 'pkg:' || type || '/' ||
  CASE WHEN namespace <> '' THEN namespace || '/' ELSE '' END || name || CASE WHEN version <> '' THEN '@' || version ELSE '' END AS component_purl,
  FALSE AS version_checked
FROM sbom_parsed p JOIN osv_keys k ON k.key = p.type || '/' || p.name OR k.key = p.type || '/' || p.namespace || '/' || p.name"""))
def _(spark, sf):
    comps = P.with_parsed_purl(sbom_lines(spark, sf).select(
        F.concat(F.lit("sbom"), F.col("l_orderkey").cast("string")).alias("sbom_id"), "purl_text"), "purl_text")
    return SF.osv_findings(comps, SF.osv_keys(osv_lines(spark, sf)))


@query("s28_bills_without_osv_key", Q.select([*_SBOM_TEXT, _OSV_KEYS], """
SELECT 'sbom' || CAST(l_orderkey AS VARCHAR) AS artifact_id, 'no component matches a key of the dump' AS reason FROM sbom_lines
WHERE l_orderkey NOT IN (SELECT l_orderkey FROM sbom_parsed p JOIN osv_keys k ON k.key = p.type || '/' || p.name OR k.key = p.type || '/' || p.namespace || '/' || p.name
  WHERE k.key LIKE 'npm/%') GROUP BY l_orderkey"""))
def _(spark, sf):
    comps = P.with_parsed_purl(sbom_lines(spark, sf).select(
        F.concat(F.lit("sbom"), F.col("l_orderkey").cast("string")).alias("sbom_id"), "purl_text"), "purl_text")
    npm = SF.osv_keys(osv_lines(spark, sf)).where(F.col("key").startswith("npm/"))  # the dump of one ecosystem
    return SF.without_osv_key(comps, npm)


@query("j09_osv_join_counts", Q.select([*_SBOM_TEXT, _OSV_KEYS], """
SELECT vulnerability AS cve, count(DISTINCT l_orderkey) AS sboms
FROM sbom_parsed p JOIN osv_keys k ON k.key = p.type || '/' || p.name OR k.key = p.type || '/' || p.namespace || '/' || p.name GROUP BY vulnerability"""))
def _(spark, sf):
    comps = P.with_parsed_purl(sbom_lines(spark, sf).select(F.col("l_orderkey").cast("string").alias("sbom_id"), "purl_text"), "purl_text")
    return SF.osv_findings(comps, SF.osv_keys(osv_lines(spark, sf))).groupBy("cve").agg(F.countDistinct("artifact_id").alias("sboms"))


# -------------------------------------------------------------------- bills

_PART_PURL = "concat('pkg:generic/', replace(p_name, ' ', '-'), '@1.', p_size)"
_CDX_DOC = f"""to_json(named_struct('bomFormat', 'CycloneDX',
  'metadata', named_struct('component', named_struct('bom-ref', 'top', 'type', 'application', 'name', 'top', 'purl', concat('pkg:generic/top@', p_partkey))),
  'components', array(
    named_struct('bom-ref', 'a', 'type', 'library', 'name', p_name, 'purl', {_PART_PURL}),
    named_struct('bom-ref', 'b', 'type', if(p_partkey % 2 = 0, 'container', 'library'), 'name', 'b', 'purl', 'pkg:generic/b@1'),
    named_struct('bom-ref', 'c', 'type', 'firmware', 'name', 'c', 'purl', 'pkg:generic/c@1'),
    named_struct('bom-ref', 'd', 'type', 'library', 'name', 'd', 'purl', '')),
  'dependencies', array(named_struct('ref', 'top', 'dependsOn', array('a', 'c')))))"""
_SPDX_DOC = f"""to_json(named_struct('spdxVersion', 'SPDX-2.3',
  'packages', array(
    named_struct('name', 'none', 'SPDXID', 'SPDXRef-0', 'primaryPackagePurpose', 'LIBRARY', 'externalRefs', array(named_struct('referenceType', 'cpe23Type', 'referenceLocator', 'x'))),
    named_struct('name', p_name, 'SPDXID', 'SPDXRef-1', 'primaryPackagePurpose', 'LIBRARY', 'externalRefs', array(named_struct('referenceType', 'purl', 'referenceLocator', {_PART_PURL}))),
    named_struct('name', 'b', 'SPDXID', 'SPDXRef-2', 'primaryPackagePurpose', 'LIBRARY', 'externalRefs', array(named_struct('referenceType', 'purl', 'referenceLocator', 'pkg:generic/b@1')))),
  'relationships', if(p_partkey % 2 = 0, array(named_struct('relationshipType', 'DESCRIBES', 'spdxElementId', 'SPDXRef-DOCUMENT', 'relatedSpdxElement', 'SPDXRef-2')),
    array(named_struct('relationshipType', 'CONTAINS', 'spdxElementId', 'SPDXRef-DOCUMENT', 'relatedSpdxElement', 'SPDXRef-2')))))"""


def part_documents(spark, sf, body):
    return W.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.expr(body).alias("content"))


_CDX_ROWS = """SELECT CAST(p_partkey AS VARCHAR) AS sbom_id, c.name, c.purl_text, c.is_root FROM part, LATERAL (
  VALUES ('top', 'pkg:generic/top@' || CAST(p_partkey AS VARCHAR), TRUE),
    (p_name, 'pkg:generic/' || replace(p_name, ' ', '-') || '@1.' || CAST(p_size AS VARCHAR), FALSE),
    ('b', 'pkg:generic/b@1', p_partkey % 2 = 0), ('c', 'pkg:generic/c@1', FALSE)) c(name, purl_text, is_root)"""
_SPDX_ROWS = """SELECT CAST(p_partkey AS VARCHAR) AS sbom_id, c.name, c.purl_text, c.is_root FROM part, LATERAL (
  VALUES (p_name, 'pkg:generic/' || replace(p_name, ' ', '-') || '@1.' || CAST(p_size AS VARCHAR), p_partkey % 2 = 1),
    ('b', 'pkg:generic/b@1', p_partkey % 2 = 0)) c(name, purl_text, is_root)"""


@query("s06_cyclonedx_components", _CDX_ROWS)
def _(spark, sf):
    return SB.cyclonedx_components(part_documents(spark, sf, _CDX_DOC))


@query("s07_spdx_components", _SPDX_ROWS)
def _(spark, sf):
    return SB.spdx_components(part_documents(spark, sf, _SPDX_DOC))


@query("s08_mixed_sbom_formats", f"""
SELECT sbom_id, name, purl_text, is_root FROM ({_CDX_ROWS} WHERE p_partkey % 3 = 0 UNION ALL {_SPDX_ROWS} WHERE p_partkey % 3 = 1)""")
def _(spark, sf):
    body = f"CASE p_partkey % 3 WHEN 0 THEN {_CDX_DOC} WHEN 1 THEN {_SPDX_DOC} ELSE '{{}}' END"
    return SB.load_sboms(part_documents(spark, sf, body)).select("sbom_id", "name", "purl_text", "is_root")


@query("s08_unrecognized_sboms", "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'no known bill of materials' AS reason FROM part WHERE p_partkey % 3 = 2")
def _(spark, sf):
    body = f"CASE p_partkey % 3 WHEN 0 THEN {_CDX_DOC} WHEN 1 THEN {_SPDX_DOC} ELSE if(p_size % 2 = 0, '{{}}', '{{broken') END"
    return SB.unrecognized(part_documents(spark, sf, body))


@query("s23_sbom_package_counts", """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'cyclonedx' ELSE 'spdx' END AS format,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 3 END AS BIGINT) AS total, CAST(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS with_purl,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS purls FROM part""")
def _(spark, sf):
    return SB.sbom_counts(part_documents(spark, sf, f"CASE p_partkey % 2 WHEN 0 THEN {_CDX_DOC} ELSE {_SPDX_DOC} END"))


@query("p19_components_with_source_names", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'SrcName=' || lower(p_brand) || ';SrcVersion=' || CAST(p_size AS VARCHAR)
  ELSE 'SrcName=' || p_name || ';SrcVersion=' || CAST(p_size AS VARCHAR) END AS added FROM part""")
def _(spark, sf):
    comp = F.expr("""array(named_struct('name', p_name, 'version', CAST(p_size AS STRING), 'properties', CASE p_partkey % 3 WHEN 0 THEN CAST(NULL AS ARRAY<STRUCT<name: STRING, value: STRING>>)
      WHEN 1 THEN array(named_struct('name', 'syft:metadata:source', 'value', lower(p_brand))) ELSE array(named_struct('name', 'x', 'value', 'y')) END))""")
    enriched = SB.with_source_names(comp)[0]["properties"]
    added = F.filter(enriched, lambda p: p["name"].startswith("aquasecurity:"))
    text = F.array_join(F.transform(added, lambda p: F.concat(F.substring_index(p["name"], ":", -1), F.lit("="), p["value"])), ";")
    return W.table(spark, sf, "part").select("p_partkey", F.coalesce(text, F.lit("")).alias("added"))


@query("s24_consumer_scan_counts", """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(CASE p_partkey % 3 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS unique_vulns, CAST(CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS packages_observed,
  CAST(1 AS BIGINT) AS src_ne_binary FROM part""")
def _(spark, sf):
    trivy = """to_json(named_struct('Results', array(named_struct('Packages', array(named_struct('Name', p_name, 'SrcName', p_brand), named_struct('Name', 'x', 'SrcName', 'x')),
      'Vulnerabilities', array(named_struct('VulnerabilityID', 'CVE-1'), named_struct('VulnerabilityID', 'CVE-1'))))))"""
    art = "named_struct('name', 'lib', 'version', '1', 'purl', concat('pkg:deb/x/lib@', p_size), 'upstreams', array(named_struct('name', p_name)))"
    other = "named_struct('name', 'z', 'version', '1', 'purl', 'pkg:deb/x/z@1', 'upstreams', array(named_struct('name', 'z')))"
    one = f"to_json(named_struct('matches', array(named_struct('vulnerability', named_struct('id', 'CVE-1'), 'artifact', {art}), named_struct('vulnerability', named_struct('id', 'CVE-1'), 'artifact', {art}))))"
    two = f"to_json(named_struct('matches', array(named_struct('vulnerability', named_struct('id', 'CVE-1'), 'artifact', {art}), named_struct('vulnerability', named_struct('id', 'CVE-2'), 'artifact', {other}))))"
    return SF.consumer_counts(part_documents(spark, sf, f"CASE p_partkey % 3 WHEN 0 THEN {trivy} WHEN 1 THEN {one} ELSE {two} END"))


@query("s19_scanner_metadata", """
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'grype' AS scanner, CAST(p_size AS VARCHAR) AS version,
  CASE p_partkey % 3 WHEN 0 THEN 'b' || CAST(p_size AS VARCHAR) WHEN 1 THEN 't' || CAST(p_size AS VARCHAR) END AS database_built FROM part""")
def _(spark, sf):
    body = """CASE p_partkey % 3 WHEN 0 THEN to_json(named_struct('descriptor', named_struct('name', 'grype', 'version', CAST(p_size AS STRING), 'db', named_struct('built', concat('b', p_size)))))
      WHEN 1 THEN to_json(named_struct('descriptor', named_struct('name', 'grype', 'version', CAST(p_size AS STRING), 'database', named_struct('timestamp', concat('t', p_size)))))
      ELSE to_json(named_struct('descriptor', named_struct('name', 'grype', 'version', CAST(p_size AS STRING)))) END"""
    return SF.scanner_metadata(part_documents(spark, sf, body))


# ------------------------------------------------------------ VEX documents

_OPENVEX_DOC = f"""to_json(named_struct('@context', 'https://openvex.dev/ns/v0.2.0', 'statements', array(
  named_struct('vulnerability', named_struct('name', concat('CVE-2024-', p_partkey)), 'products', array(named_struct('@id', {_PART_PURL}, 'identifiers', named_struct('purl', {_PART_PURL}))), 'status', 'not_affected'),
  named_struct('vulnerability', named_struct('name', 'none'), 'products', array(named_struct('@id', 'urn:x', 'identifiers', named_struct('purl', CAST(NULL AS STRING)))), 'status', 'fixed'))))"""
_CDXVEX_DOC = f"""to_json(named_struct('bomFormat', 'CycloneDX', 'components', array(named_struct('bom-ref', 'a', 'purl', {_PART_PURL})),
  'vulnerabilities', array(named_struct('id', concat('CVE-2024-', p_partkey), 'affects', array(named_struct('ref', 'a'), named_struct('ref', 'pkg:generic/z@1'), named_struct('ref', 'a'), named_struct('ref', 'gone')),
    'analysis', named_struct('state', if(p_partkey % 2 = 0, 'not_affected', 'exploitable'))))))"""
_CSAF_DOC = f"""to_json(named_struct('document', named_struct('title', 't'), 'product_tree', named_struct(
  'branches', array(named_struct('category', 'vendor', 'branches', array(
     named_struct('category', 'product_name', 'branches', array(named_struct('category', 'product_version', 'product', named_struct('product_id', 'lib', 'name', 'lib', 'product_identification_helper', named_struct('purl', {_PART_PURL}))))))),
     named_struct('category', 'vendor', 'branches', CAST(NULL AS ARRAY<STRUCT<category: STRING, branches: ARRAY<STRUCT<category: STRING, product: STRUCT<product_id: STRING, name: STRING, product_identification_helper: STRUCT<purl: STRING>>>>>>))),
  'relationships', array(
     named_struct('product_reference', 'lib', 'relates_to_product_reference', 'os', 'full_product_name', named_struct('product_id', 'os:lib')),
     named_struct('product_reference', 'os:lib', 'relates_to_product_reference', 'os2', 'full_product_name', named_struct('product_id', 'os2:lib')),
     named_struct('product_reference', 'later', 'relates_to_product_reference', 'os', 'full_product_name', named_struct('product_id', 'os:later')))),
  'vulnerabilities', array(named_struct('cve', concat('CVE-2024-', p_partkey),
    'product_status', map('known_not_affected', array('os:lib', 'os2:lib', 'missing', 'pkg:generic/direct@1'), 'fixed', array('lib', 'os:later')),
    'flags', array(named_struct('label', 'first', 'product_ids', array('os:lib')), named_struct('label', 'second', 'product_ids', array('os:lib', 'os2:lib')))))))"""

_PURL_SQL = "'pkg:generic/' || replace(p_name, ' ', '-') || '@1.' || CAST(p_size AS VARCHAR)"
_CVE_OF = "'CVE-2024-' || CAST(p_partkey AS VARCHAR)"
_OPENVEX_ROWS = f"SELECT CAST(p_partkey AS VARCHAR) AS doc_id, {_CVE_OF} AS vulnerability, {_PURL_SQL} AS products, 'known_not_affected' AS status FROM part"
_CDXVEX_ROWS = f"""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, {_CVE_OF} AS vulnerability, {_PURL_SQL} || ',pkg:generic/z@1' AS products,
  CASE WHEN p_partkey % 2 = 0 THEN 'known_not_affected' ELSE 'exploitable' END AS status FROM part"""
_CSAF_ROWS = f"""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, {_CVE_OF} AS vulnerability, coalesce(c.purl, {_PURL_SQL}) AS products, c.product_id,
  c.platform, c.status, c.justification, c.indirect FROM part, LATERAL (VALUES
    ('os:lib', CAST(NULL AS VARCHAR), 'os', 'known_not_affected', 'first', TRUE), ('os2:lib', NULL, 'os2', 'known_not_affected', 'second', TRUE),
    ('pkg:generic/direct@1', 'pkg:generic/direct@1', NULL, 'known_not_affected', NULL, FALSE), ('lib', NULL, NULL, 'fixed', NULL, FALSE))
  c(product_id, purl, platform, status, justification, indirect)"""


def _joined(rows):
    return rows.withColumn("products", F.array_join("products", ","))


@query("s09_openvex_statements", _OPENVEX_ROWS)
def _(spark, sf):
    return _joined(SV.openvex_statements(part_documents(spark, sf, _OPENVEX_DOC))).select("doc_id", "vulnerability", "products", "status")


@query("s10_cyclonedx_vex_statements", _CDXVEX_ROWS)
def _(spark, sf):
    return _joined(SV.cyclonedx_statements(part_documents(spark, sf, _CDXVEX_DOC))).select("doc_id", "vulnerability", "products", "status")


@query("s11_csaf_statements", _CSAF_ROWS)
def _(spark, sf):
    return _joined(SV.csaf_statements(part_documents(spark, sf, _CSAF_DOC)))


@query("s12_mixed_vex_formats", f"""
SELECT doc_id, vulnerability, products, status FROM (
  SELECT * FROM ({_OPENVEX_ROWS}) WHERE CAST(doc_id AS BIGINT) % 4 = 0
  UNION ALL SELECT * FROM ({_CDXVEX_ROWS}) WHERE CAST(doc_id AS BIGINT) % 4 = 1
  UNION ALL SELECT doc_id, vulnerability, products, status FROM ({_CSAF_ROWS}) WHERE CAST(doc_id AS BIGINT) % 4 = 2)""")
def _(spark, sf):
    body = f"CASE p_partkey % 4 WHEN 0 THEN {_OPENVEX_DOC} WHEN 1 THEN {_CDXVEX_DOC} WHEN 2 THEN {_CSAF_DOC} ELSE '{{}}' END"
    return _joined(SV.load_vex(part_documents(spark, sf, body))).select("doc_id", "vulnerability", "products", "status")


@query("j11_vex_component_references", f"SELECT doc_id, count(*) AS n FROM ({_CDXVEX_ROWS}) GROUP BY doc_id")
def _(spark, sf):
    return SV.cyclonedx_statements(part_documents(spark, sf, _CDXVEX_DOC)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("j12_csaf_products", f"""
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, c.product_id, {_PURL_SQL} AS purl_text, c.platform, c.indirect FROM part, LATERAL (VALUES
  ('lib', CAST(NULL AS VARCHAR), FALSE), ('os:lib', 'os', TRUE), ('os2:lib', 'os2', TRUE)) c(product_id, platform, indirect)""")
def _(spark, sf):
    return SV.csaf_products(part_documents(spark, sf, _CSAF_DOC))


@query("j13_csaf_flag_justifications", f"""
SELECT justification, count(*) AS n FROM ({_CSAF_ROWS}) GROUP BY justification""")
def _(spark, sf):
    return SV.csaf_statements(part_documents(spark, sf, _CSAF_DOC)).groupBy("justification").agg(F.count(F.lit(1)).alias("n"))


@query("s12_unrecognized_vex", "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'no known VEX document' AS reason FROM part WHERE p_partkey % 4 = 3")
def _(spark, sf):
    body = f"CASE p_partkey % 4 WHEN 0 THEN {_OPENVEX_DOC} WHEN 1 THEN {_CDXVEX_DOC} WHEN 2 THEN {_CSAF_DOC} ELSE if(p_size % 2 = 0, '{{}}', '{{broken') END"
    return SV.unrecognized(part_documents(spark, sf, body))


@query("s13_verifier_statements", f"""
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN {_CVE_OF} ELSE 'cve-x' END AS vulnerability,
  CASE WHEN p_partkey % 2 = 0 THEN {_PURL_SQL} ELSE 'pkg:a/b' END AS product_purl, CASE WHEN p_partkey % 2 = 0 THEN 'not_affected' ELSE 'affected' END AS status FROM part""")
def _(spark, sf):
    native = "to_json(named_struct('format', 'native', 'statements', array(named_struct('cve', 'cve-x', 'purl', 'pkg:a/b', 'status', 'affected'))))"
    docs = part_documents(spark, sf, f"CASE p_partkey % 2 WHEN 0 THEN {_OPENVEX_DOC} ELSE {native} END")
    return SV.verifier_statements(docs).drop("justification")


# -------------------------------------------------------------------- audit

_STATEMENTS = [*_SBOM_TEXT, """sbom_components AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS sbom_id, 'ref-' || CAST(l_linenumber AS VARCHAR) AS bom_ref,
    CASE WHEN p_size % 9 = 0 THEN 'application' ELSE 'library' END AS ctype, l_linenumber = 1 AS is_metadata, p.* FROM sbom_parsed p),
sbom_edges AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS sbom_id, 'ref-' || CAST(l_linenumber + 1 AS VARCHAR) AS bom_ref FROM line_parts WHERE l_linenumber % 2 = 1),
flagged AS (
  SELECT c.*, c.is_metadata OR (e.bom_ref IS NULL AND (m.bom_ref IS NOT NULL OR c.ctype = 'application')) AS is_root
  FROM sbom_components c LEFT JOIN sbom_edges e ON c.sbom_id = e.sbom_id AND c.bom_ref = e.bom_ref
  LEFT JOIN (SELECT DISTINCT sbom_id, bom_ref FROM sbom_components WHERE is_metadata) m ON c.sbom_id = m.sbom_id AND c.bom_ref = m.bom_ref)""",
    f"""statements AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(p_partkey AS VARCHAR) AS statement_id,
    CAST(l_orderkey AS VARCHAR) AS sbom_id, CASE o_orderstatus WHEN 'F' THEN 'known_not_affected' WHEN 'O' THEN 'known_affected' END AS status,
    CASE p_size % 4 WHEN 0 THEN 'pkg:generic/' || {W._NAME} || '@' || {W._VERSION} WHEN 1 THEN 'pkg:deb/debian/' || {W._NAME} || '@' || {W._VERSION}
      WHEN 2 THEN 'pkg:deb/debian/' || {W._NAME} ELSE 'pkg:npm/%40acme/' || {W._NAME} || '@' || {W._VERSION} END AS product_text
  FROM line_parts JOIN orders ON l_orderkey = o_orderkey)""",
    Q.parsed("statements", "product_text", "products")]
_GRADED = [*_STATEMENTS, f"""graded AS (
  SELECT p.statement_id, p.sbom_id, p.status, p.product_text, c.purl_text, c.is_root, {Q.quality('p', 'c')} AS quality
  FROM products p JOIN flagged c ON p.sbom_id = c.sbom_id AND p.name = c.name),
audited AS (
  SELECT s.statement_id, s.status, CASE WHEN coalesce(s.status, 'known_not_affected') <> 'known_not_affected' THEN 'ok' WHEN p.version = '' THEN 'versionless'
    WHEN coalesce(g.best, 0) < 3 THEN 'inert' WHEN g.sub > 0 AND g.root = 0 THEN 'overbroad' ELSE 'ok' END AS audit_status
  FROM statements s JOIN products p ON s.statement_id = p.statement_id LEFT JOIN (
    SELECT statement_id, max(quality) AS best, count(*) FILTER (WHERE quality >= 3 AND is_root) AS root,
      count(*) FILTER (WHERE quality >= 3 AND NOT is_root) AS sub FROM graded GROUP BY statement_id) g ON s.statement_id = g.statement_id)"""]


def sbom_components(spark, sf):
    rows = sbom_lines(spark, sf).select(
        F.col("l_orderkey").cast("string").alias("sbom_id"), F.concat(F.lit("ref-"), F.col("l_linenumber").cast("string")).alias("bom_ref"),
        F.when(F.col("p_size") % 9 == 0, "application").otherwise("library").alias("type"),
        (F.col("l_linenumber") == 1).alias("is_metadata"), "purl_text")
    edges = W.table(spark, sf, "lineitem").where(F.col("l_linenumber") % 2 == 1).select(
        F.col("l_orderkey").cast("string").alias("sbom_id"),
        F.concat(F.lit("ref-"), (F.col("l_linenumber") + 1).cast("string")).alias("child_ref"))
    return P.with_parsed_purl(A.root_flags(rows, edges), "purl_text")


def vex_statements(spark, sf):
    product = (f"CASE p_size % 4 WHEN 0 THEN 'pkg:generic/' || {W._NAME} || '@' || {W._VERSION} WHEN 1 THEN 'pkg:deb/debian/' || {W._NAME} || '@' || {W._VERSION} "
               f"WHEN 2 THEN 'pkg:deb/debian/' || {W._NAME} ELSE 'pkg:npm/%40acme/' || {W._NAME} || '@' || {W._VERSION} END")
    orders = W.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    lines = W._line_parts(spark, sf)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("p_partkey").cast("string")).alias("statement_id"),
        F.col("l_orderkey").cast("string").alias("sbom_id"),
        F.when(F.col("o_orderstatus") == "F", "known_not_affected").when(F.col("o_orderstatus") == "O", "known_affected").alias("status"),
        F.array(F.expr(product)).alias("products")).distinct()


@query("j15_sbom_roots", Q.select(_STATEMENTS, "SELECT sbom_id, bom_ref, purl_text, is_root FROM flagged"))
def _(spark, sf):
    return sbom_components(spark, sf).select("sbom_id", "bom_ref", "purl_text", "is_root")


@query("j10_graded_vex_matches", Q.select(_GRADED, """
SELECT statement_id, purl_text, is_root, quality FROM graded WHERE quality > 0"""))
def _(spark, sf):
    rows = vex_statements(spark, sf).select("statement_id", "sbom_id", F.explode("products").alias("product_text"))
    comps = sbom_components(spark, sf)
    return A.graded_matches(P.with_parsed_purl(rows, "product_text", "product"), comps).select(
        "statement_id", F.replace("component", F.lit("@acme"), F.lit("%40acme")).alias("purl_text"), "is_root", "quality")


@query("a21_vex_audit", Q.select(_GRADED, "SELECT statement_id, status, audit_status FROM audited"))
def _(spark, sf):
    return A.audit(vex_statements(spark, sf), sbom_components(spark, sf)).select("statement_id", "status", "audit_status")


@query("a23_audit_failures", Q.select(_GRADED, """
SELECT count(*) AS statements, bool_or(audit_status <> 'ok') AS failed FROM audited"""))
def _(spark, sf):
    return A.has_failures(A.audit(vex_statements(spark, sf), sbom_components(spark, sf)))


@query("p12_suppression_statements", Q.select(_STATEMENTS, """
SELECT coalesce(status, 'known_not_affected') = 'known_not_affected' AS suppresses, count(*) AS n FROM statements GROUP BY 1"""))
def _(spark, sf):
    return vex_statements(spark, sf).groupBy(A.is_suppression(F.col("status")).alias("suppresses")).agg(F.count(F.lit(1)).alias("n"))


@query("o02_best_vex_match", Q.select(_GRADED, """
SELECT statement_id, quality, purl_text FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY quality DESC, replace(purl_text, '%40', '@')) AS rn
  FROM graded WHERE quality > 0) WHERE rn = 1"""))
def _(spark, sf):
    rows = vex_statements(spark, sf).select("statement_id", "sbom_id", F.explode("products").alias("product_text"))
    graded = A.graded_matches(P.with_parsed_purl(rows, "product_text", "product"), sbom_components(spark, sf))
    first = F.min(F.struct((-F.col("quality")).alias("negated"), "component"))
    return graded.groupBy("statement_id").agg(first.alias("m")).select(
        "statement_id", (-F.col("m.negated")).alias("quality"),
        F.replace("m.component", F.lit("@acme"), F.lit("%40acme")).alias("purl_text"))


@query("w03_first_registration_wins", f"""
SELECT CAST(p_partkey AS VARCHAR) AS doc_id, {_PURL_SQL} AS purl_text, CASE WHEN p_partkey % 2 = 0 THEN 'os' END AS platform FROM part""")
def _(spark, sf):
    rows = W.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.expr(_PART_PURL).alias("own"), "p_partkey")
    regs = rows.select("doc_id", F.inline(F.array(
        F.struct(F.lit("id").alias("product_id"), F.col("own").alias("purl_text"), F.lit(None).cast("string").alias("platform"), F.array(F.lit(0)).alias("place"), F.lit(False).alias("indirect")),
        F.struct(F.lit("id").alias("product_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("own")).otherwise("pkg:other/x").alias("purl_text"), F.lit("os").alias("platform"), F.array(F.lit(1)).alias("place"), F.lit(True).alias("indirect")))))
    return SV.first_registrations(regs).select("doc_id", "purl_text", "platform")
