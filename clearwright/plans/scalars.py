"""Queries that exercise the column builders over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwright.functions import ids as I
from clearwright.functions import purl as P
from clearwright.functions import symbols as S
from clearwright.functions import text as T
from clearwright.functions import verdict as V
from clearwright.operators import resolve as R
from clearwright.plans import sqltext as Q
from clearwright.plans import views as W
from clearwright.plans.registry import query

_PARSED = [W.FINDINGS, Q.parsed("(SELECT DISTINCT component_purl FROM findings)", "component_purl", "parsed_findings")]


def parsed(spark, sf):
    return P.with_purl(W.findings(spark, sf).select("component_purl").distinct(), "component_purl")


@query("f01_purl_parts", Q.select(_PARSED, """
SELECT component_purl, CASE WHEN ok THEN type END AS type, CASE WHEN ok THEN namespace END AS namespace, CASE WHEN ok THEN name END AS name,
  CASE WHEN ok THEN version END AS version, CASE WHEN ok THEN array_to_string(quals, '&') END AS qualifiers, CASE WHEN ok THEN subpath END AS subpath
FROM parsed_findings"""))
def _(spark, sf):
    p = F.col("purl")
    return parsed(spark, sf).select(
        "component_purl", p["type"].alias("type"), p["namespace"].alias("namespace"), p["name"].alias("name"),
        p["version"].alias("version"), P.qualifiers_text(p["qualifiers"]).alias("qualifiers"), p["subpath"].alias("subpath"))


_URL_PURL = r"""'pkg:GEM/' || replace(regexp_replace(url, '^https?://', ''), '@', '%40')"""


@query("f01_purl_parts_of_page_urls", Q.select([
    f"url_purls AS (SELECT page_id, {_URL_PURL} AS text FROM pages)",
    Q.parsed("url_purls", "text", "url_parsed")], """
SELECT page_id, CASE WHEN ok THEN type END AS type, CASE WHEN ok THEN name END AS name,
  CASE WHEN ok THEN array_to_string(quals, '&') END AS qualifiers, CASE WHEN ok THEN subpath END AS subpath FROM url_parsed"""))
def _(spark, sf):
    pages = W.table(spark, sf, "pages").select("page_id", F.expr(_URL_PURL).alias("text"))
    p = F.col("purl")
    return P.with_purl(pages, "text").select(
        "page_id", p["type"].alias("type"), p["name"].alias("name"),
        P.qualifiers_text(p["qualifiers"]).alias("qualifiers"), p["subpath"].alias("subpath"))


@query("f02_percent_decode", """
SELECT page_id, url_decode('a%20' || replace(url, '%', '') || '+%2Fb') AS decoded FROM pages""")
def _(spark, sf):
    text = F.concat(F.lit("a%20"), F.replace("url", F.lit("%"), F.lit("")), F.lit("+%2Fb"))
    return W.table(spark, sf, "pages").select("page_id", P.percent_decode(text).alias("decoded"))


@query("f03_query_entries", r"""
SELECT page_id, lower(string_split(q, '=')[1]) AS key, regexp_replace(q, '^[^=]*=', '') AS value
FROM (SELECT page_id, unnest(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: contains(x, '='))) AS q FROM pages)""")
def _(spark, sf):
    parts = F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda x: x.contains("="))
    return W.table(spark, sf, "pages").select(
        "page_id", F.inline(P.keep_last_of_each_key(P.qualifier_entries(parts))))


@query("f04_type_folding", """
SELECT p_partkey, t AS type, CASE t WHEN 'pypi' THEN translate(lower(n), '_.', '--') WHEN 'npm' THEN lower(n) WHEN 'gem' THEN lower(n)
  WHEN 'golang' THEN lower(n) ELSE n END AS name
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' WHEN 2 THEN 'golang' WHEN 3 THEN 'gem' ELSE 'maven' END AS t,
  replace(upper(p_name), ' ', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '.' END) AS n FROM part)""")
def _(spark, sf):
    spelled = F.element_at(F.array(*[F.lit(t) for t in ("PyPI", "npm", "go", "rubygems", "maven")]),
                           (F.col("p_partkey") % 5 + 1).cast("int"))
    sep = F.when(F.col("p_partkey") % 2 == 0, "_").otherwise(".")
    text = F.concat(F.lit("pkg:"), spelled, F.lit("/"), F.replace(F.upper("p_name"), F.lit(" "), sep))
    part = W.table(spark, sf, "part").select("p_partkey", text.alias("text"))
    return P.with_purl(part, "text").select("p_partkey", "purl.type", "purl.name")


@query("f05_canonical_purl", Q.select(_PARSED, """
SELECT component_purl, CASE WHEN ok THEN 'pkg:' || type || '/' || CASE WHEN namespace <> '' THEN replace(url_encode(namespace), '%40', '@') || '/' ELSE '' END
  || url_encode(name) || CASE WHEN version <> '' THEN '@' || replace(url_encode(version), '%3A', ':') ELSE '' END
  || CASE WHEN len(quals) > 0 THEN '?' || array_to_string(list_transform(quals, lambda x: url_encode(string_split(x, '=')[1]) || '=' || url_encode(regexp_replace(x, '^[^=]*=', ''))), '&') ELSE '' END END AS canonical
FROM parsed_findings"""))
def _(spark, sf):
    return parsed(spark, sf).select("component_purl", F.col("purl.canonical").alias("canonical"))


@query("f06_graded_equivalence", Q.select([*Q.DIRECT], f"""
SELECT f.component_purl, c.purl_text, {Q.quality('f', 'c')} AS quality,
  CASE {Q.quality('f', 'c')} {Q._LABELS} END AS label
FROM parsed_findings f JOIN catalogue c ON f.name = c.name WHERE f.ok"""))
def _(spark, sf):
    cat = P.with_purl(W.component_purls(spark, sf), "purl_text", "other").withColumn("name", F.col("other.name"))
    own = parsed(spark, sf).withColumn("name", F.col("purl.name"))
    rank = P.match_quality(F.col("purl"), F.col("other"))
    return own.join(cat, "name").select("component_purl", "purl_text", rank.alias("quality")).withColumn(
        "label", P.quality_label(F.col("quality")))


@query("f07_digest_conflicts", Q.select([*_PARSED], """
SELECT count(*) AS n, count(*) FILTER (WHERE ck IS NOT NULL AND ck <> 'sha256:14') AS conflicts
FROM (SELECT nullif(list_transform(list_filter(quals, lambda x: starts_with(x, 'checksum=')), lambda x: substr(x, 10))[1], '') AS ck FROM parsed_findings WHERE ok)"""))
def _(spark, sf):
    other = F.struct(F.lit("sha256:14").alias("checksum"))
    return parsed(spark, sf).where(F.col("purl").isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(P.digest_conflict(F.col("purl"), other)).alias("conflicts"))


@query("f08_same_qualifiers", Q.select([*_PARSED], """
SELECT count(*) FILTER (WHERE quals = ['arch=x86_64', 'checksum=sha256:14']) AS n FROM parsed_findings WHERE ok"""))
def _(spark, sf):
    pair = F.struct(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (
        ("checksum", "sha256:14"), ("arch", "x86_64"))]).alias("qualifiers"))
    return parsed(spark, sf).where(F.col("purl").isNotNull()).agg(
        F.count_if(P.same_qualifiers(F.col("purl"), pair)).alias("n"))


@query("f09_quality_labels", Q.select([*Q.DIRECT], f"""
SELECT CASE direct_quality {Q._LABELS} END AS label, direct_quality >= 3 AS strong, count(*) AS n FROM direct GROUP BY ALL"""))
def _(spark, sf):
    q = F.col("direct_quality")
    direct = R.direct_matches(W.findings(spark, sf), W.component_purls(spark, sf))
    return direct.groupBy(P.quality_label(q).alias("label"), P.at_least(q, P.TYPE_NORMALIZED).alias("strong")).agg(
        F.count(F.lit(1)).alias("n"))


_UP = [*_PARSED, Q.UPSTREAM.replace("FROM direct", "FROM parsed_findings")]
_UP_NAME = r"""CASE WHEN ends_with(string_split(up_text, '@')[1], '.src.rpm')
  THEN regexp_replace(regexp_replace(string_split(up_text, '@')[1], '\.src\.rpm$', ''), '(-[0-9][^-]*)+$', '')
  ELSE string_split(up_text, '@')[1] END"""


@query("f10_upstream_sources", Q.select(_UP, f"""
SELECT component_purl, {_UP_NAME} AS source_name, nullif(regexp_extract(up_text, '^[^@]*@(.*)$', 1), '') AS source_version FROM upstreams"""))
def _(spark, sf):
    return P.with_upstream(parsed(spark, sf)).select(
        "component_purl", F.col("upstream.name").alias("source_name"), F.col("upstream.version").alias("source_version"))


@query("f11_double_decoded_upstream", """
SELECT p_partkey, lower(replace(p_brand, '#', '')) AS name, CAST(p_size AS VARCHAR) || '-1' AS version FROM part""")
def _(spark, sf):
    text = F.concat(F.lit("pkg:deb/debian/x@1?upstream="), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))),
                    F.lit("%2540"), F.col("p_size").cast("string"), F.lit("-1"))
    part = W.table(spark, sf, "part").select("p_partkey", text.alias("text"))
    return P.with_upstream(P.with_purl(part, "text")).select("p_partkey", "upstream.name", "upstream.version")


@query("f12_source_name_variants", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'gnutls' WHEN 1 THEN 'glib' WHEN 2 THEN 'gcc' WHEN 3 THEN 'gcc' WHEN 4 THEN 'gcc'
  ELSE lower(replace(p_brand, '#', '')) END AS name FROM part""")
def _(spark, sf):
    given = F.element_at(F.array(*[F.lit(x) for x in P.DEBIAN_SOURCE_VARIANTS],
                                 F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return W.table(spark, sf, "part").select(
        "p_partkey", P.normalize_source_name(F.concat(F.lit(" "), given)).alias("name"))


@query("f13_source_rpm_names", """
SELECT p_partkey, replace(p_name, ' ', '-') AS name FROM part""")
def _(spark, sf):
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string"),
                    F.lit(".2-26.el9_8.4.src.rpm"))
    return W.table(spark, sf, "part").select("p_partkey", P.strip_src_rpm(text).alias("name"))


@query("f14_upstream_versions", Q.select(_PARSED, f"""
SELECT component_purl, {Q.upstream_version('type', "nullif(trim(version), '')")} AS upstream_version FROM parsed_findings WHERE ok"""))
def _(spark, sf):
    return parsed(spark, sf).where(F.col("purl").isNotNull()).select(
        "component_purl", P.upstream_version(F.col("purl.type"), F.col("purl.version")).alias("upstream_version"))


def _version_query(name, ptype, text_sql, want_sql):
    @query(name, f"SELECT p_partkey, {want_sql} AS upstream_version FROM part")
    def _(spark, sf):
        return W.table(spark, sf, "part").select(
            "p_partkey", P.upstream_version(F.lit(ptype), F.expr(text_sql)).alias("upstream_version"))


_SIZE = "CAST(p_size AS VARCHAR(9))"
_version_query("f15_debian_versions", "deb", f"'2:3.' || {_SIZE} || '.7-1~deb12u2-' || {_SIZE}", f"'3.' || {_SIZE} || '.7'")
_version_query("f16_alpine_versions", "apk", f"'1.' || {_SIZE} || '-r' || {_SIZE}", f"'1.' || {_SIZE}")
_version_query("f17_rpm_versions", "rpm", f"'1:8.' || {_SIZE} || '-26.el9_8.4'", f"'8.' || {_SIZE}")
_version_query("f18_cosmetic_suffixes", "deb", f"'1.' || {_SIZE} || '.dfsg+really1ubuntu2-1'", f"'1.' || {_SIZE}")


@query("f19_symbol_version_split", Q.select([W.INVENTORIES, W.SYMBOLS], """
SELECT raw, CASE WHEN length(raw) % 2 = 0 THEN 'GLIBC_2.' || CAST(length(raw) AS VARCHAR) ELSE 'hint' END AS version, count(*) AS n
FROM symbols GROUP BY ALL"""))
def _(spark, sf):
    tagged = F.when(F.length("raw") % 2 == 0, F.concat(F.col("raw"), F.lit("@@GLIBC_2."), F.length("raw").cast("string"))).otherwise(F.col("raw"))
    s = W.symbols(spark, sf).withColumn("v", S.split_version(tagged, F.lit("hint")))
    return s.groupBy(F.col("v.name").alias("raw"), F.col("v.version").alias("version")).agg(F.count(F.lit(1)).alias("n"))


@query("f20_symbol_normal_form", Q.select([W.INVENTORIES, W.SYMBOLS], """
SELECT normalized, count(*) AS n FROM symbols GROUP BY normalized"""))
def _(spark, sf):
    return W.symbols(spark, sf).groupBy(
        S.normalize(F.concat(F.lit(" __wrap___real_"), F.col("raw"))).alias("normalized")).agg(F.count(F.lit(1)).alias("n"))


@query("f21_printable_runs", """
SELECT p_partkey, CASE WHEN length(p_name) >= 9 THEN p_name END AS found FROM part""")
def _(spark, sf):
    body = F.encode(F.concat(F.lit("ab\u0000\u0001"), F.col("p_name"), F.lit("\u0000tail without end")), "ISO-8859-1")
    return W.table(spark, sf, "part").select(
        "p_partkey", F.nullif(F.array_join(S.printable_runs(body, 9), "|"), F.lit("")).alias("found"))


@query("f22_binary_magic", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ELF' WHEN 1 THEN 'PE' WHEN 2 THEN 'MachO' WHEN 3 THEN 'MachO' ELSE 'unknown' END AS format FROM part""")
def _(spark, sf):
    head = F.element_at(F.array(*[F.lit(x) for x in ("7F454C46", "4D5A9000", "CFFAEDFE", "CAFEBABE", "FEEDFA00")]),
                        (F.col("p_partkey") % 5 + 1).cast("int"))
    content = F.concat(F.unhex(head), F.encode("p_name", "UTF-8"))
    return W.table(spark, sf, "part").select("p_partkey", S.magic_format(content).alias("format"))


@query("f23_content_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("f24_digest_pinned_purl", Q.select(_PARSED, """
SELECT component_purl, 'pkg:' || type || '/' || CASE WHEN namespace <> '' THEN replace(url_encode(namespace), '%40', '@') || '/' ELSE '' END
  || url_encode(name) || CASE WHEN version <> '' THEN '@' || replace(url_encode(version), '%3A', ':') ELSE '' END
  || '?' || array_to_string(list_transform(list_sort(list_append(list_filter(quals, lambda x: NOT starts_with(x, 'checksum=')), 'checksum=sha256:ab12')),
     lambda x: url_encode(string_split(x, '=')[1]) || '=' || url_encode(regexp_replace(x, '^[^=]*=', ''))), '&') AS pinned
FROM parsed_findings WHERE ok"""))
def _(spark, sf):
    return parsed(spark, sf).where(F.col("purl").isNotNull()).select(
        "component_purl", P.pinned_canonical(F.col("purl"), F.lit(" AB12")).alias("pinned"))


@query("f25_purl_without_checksum", Q.select([W.FINDINGS], """
SELECT DISTINCT component_purl, CASE WHEN contains(component_purl, 'checksum=') THEN string_split(component_purl, '?')[1] ELSE component_purl END AS stripped FROM findings"""))
def _(spark, sf):
    return W.findings(spark, sf).select("component_purl").distinct().withColumn(
        "stripped", P.without_checksum_query(F.col("component_purl")))


@query("f26_document_ids", """
SELECT o_orderkey, 'urn:clearwright:openvex:' || left(sha256('seed' || chr(0) || CAST(o_orderkey AS VARCHAR)), 32) AS document_id,
  'CWPID-' || upper(left(sha256('product-id' || chr(0) || CAST(o_orderkey AS VARCHAR)), 16)) AS product_id,
  'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT o_orderkey, sha256('clearwright-uuid' || chr(0) || sha256('seed' || chr(0) || CAST(o_orderkey AS VARCHAR))) AS h FROM orders)""")
def _(spark, sf):
    seed = I.joined_digest(F.lit("seed"), F.col("o_orderkey").cast("string"))
    return W.table(spark, sf, "orders").select("o_orderkey", seed.alias("seed")).select(
        "o_orderkey", I.document_id("openvex", F.col("seed")).alias("document_id"),
        I.product_id(F.col("o_orderkey").cast("string")).alias("product_id"), I.uuid_from(F.col("seed")).alias("uuid"))


@query("f27_derived_timestamp", """
SELECT o_orderkey, strftime(to_timestamp(1767225600 + CAST('0x' || left(sha256('vex-time' || chr(0) || CAST(o_orderkey AS VARCHAR)), 6) AS BIGINT) % 31536000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS stamp
FROM orders""")
def _(spark, sf):
    return W.table(spark, sf, "orders").select("o_orderkey", I.timestamp_from(F.col("o_orderkey").cast("string")).alias("stamp"))


@query("f28_impact_detail", """
SELECT o_orderkey, 'rule_id=D0' || CAST(o_orderkey % 4 + 1 AS VARCHAR) || ' manifest_version=' || o_orderstatus || ' bundle_id=' || CAST(o_custkey AS VARCHAR) AS detail FROM orders""")
def _(spark, sf):
    return W.table(spark, sf, "orders").select("o_orderkey", V.impact_detail(
        F.concat(F.lit(" D0"), (F.col("o_orderkey") % 4 + 1).cast("string")), F.col("o_orderstatus"),
        F.col("o_custkey").cast("string")).alias("detail"))


@query("f29_vex_statuses", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'not_affected' WHEN 'O' THEN 'affected' ELSE 'under_investigation' END AS openvex,
  CASE o_orderstatus WHEN 'F' THEN 'not_affected' WHEN 'O' THEN 'exploitable' ELSE 'in_triage' END AS cyclonedx,
  CASE o_orderstatus WHEN 'F' THEN 'known_not_affected' WHEN 'O' THEN 'known_affected' ELSE 'under_investigation' END AS csaf FROM orders""")
def _(spark, sf):
    verdict = F.when(F.col("o_orderstatus") == "F", V.NOT_AFFECTED).when(F.col("o_orderstatus") == "O", V.AFFECTED).otherwise(V.UNDER_INVESTIGATION)
    return W.table(spark, sf, "orders").select(
        "o_orderkey", V.status_of(verdict, V.OPENVEX_STATUS).alias("openvex"),
        V.status_of(verdict, V.CYCLONEDX_STATE).alias("cyclonedx"), V.status_of(verdict, V.CSAF_STATUS).alias("csaf"))


@query("f30_component_name_and_version", Q.select(_PARSED, "SELECT component_purl, name, nullif(version, '') AS version FROM parsed_findings WHERE ok"))
def _(spark, sf):
    return parsed(spark, sf).where(F.col("purl").isNotNull()).select(
        "component_purl", "purl.name", F.nullif(F.col("purl.version"), F.lit("")).alias("version"))


@query("f31_vex_status_keys", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'known_not_affected' WHEN 'O' THEN 'known_affected' ELSE 'Pending' END AS status FROM orders""")
def _(spark, sf):
    given = F.when(F.col("o_orderstatus") == "F", " Not_Affected").when(F.col("o_orderstatus") == "O", "AFFECTED").otherwise("Pending")
    return W.table(spark, sf, "orders").select("o_orderkey", V.vex_status_key(given).alias("status"))


@query("f33_evidence_kinds", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'component_not_present' WHEN o_orderkey % 2 = 0 THEN 'vulnerable_code_not_present' ELSE 'symbols_absent' END AS kind FROM orders""")
def _(spark, sf):
    j = F.when(F.col("o_orderstatus") == "F", V.COMPONENT_ABSENT).otherwise(V.CODE_ABSENT)
    return W.table(spark, sf, "orders").select("o_orderkey", V.evidence_kind(j, F.col("o_orderkey") % 2).alias("kind"))


@query("f34_safe_labels", r"""
SELECT doc_id, CASE WHEN length(c) <= 40 THEN c ELSE left(c, 40) || '...' END AS label
FROM (SELECT doc_id, regexp_replace(regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '[\x00-\x08\x0b-\x1f\x{202a}-\x{202e}\x{2066}-\x{2069}]', '', 'g'), '[^\x20-\x7e\n\t]', '?', 'g') AS c FROM documents)""")
def _(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", T.safe_label(F.col("text"), 40).alias("label"))


@query("f35_format_validators", Q.select([W.RAW_FINDINGS], r"""
SELECT count(*) FILTER (WHERE regexp_matches(upper(trim(cve)), '^CVE-[0-9]{4}-[0-9]{4,}$')) AS good_cves,
  count(*) FILTER (WHERE regexp_matches(cve, '^CVE-[0-9]{4}-[0-9]{4,}$')) AS exact_cves, count(*) AS n FROM raw_findings"""))
def _(spark, sf):
    return W.raw_findings(spark, sf).agg(
        F.count_if(T.is_cve(F.upper(F.trim("cve")))).alias("good_cves"), F.count_if(T.is_cve(F.col("cve"))).alias("exact_cves"),
        F.count(F.lit(1)).alias("n"))


@query("f38_commit_urls", """
SELECT p_partkey, 'https://example.org/org/' || replace(p_name, ' ', '-') || '/commit/' || md5(p_name) AS link FROM part""")
def _(spark, sf):
    repo = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("git@example.org:org/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".git"))).otherwise(
        F.concat(F.lit("https://example.org/org/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/")))
    return W.table(spark, sf, "part").select("p_partkey", T.commit_url(repo, F.md5("p_name")).alias("link"))


@query("f39_purl_type_of_text", Q.select([W.FINDINGS], """
SELECT coalesce(nullif(regexp_extract(component_purl, '^pkg:([^/]*)', 1), ''), 'unknown') AS type, count(*) AS n FROM findings GROUP BY 1"""))
def _(spark, sf):
    return W.findings(spark, sf).groupBy(P.type_of_text(F.col("component_purl")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("f40_manifest_version_parts", """
SELECT p_partkey, '1.' || CAST(p_size AS VARCHAR) AS semver, CASE WHEN p_partkey % 2 = 0 THEN 'h+' || CAST(p_partkey AS VARCHAR) ELSE 'slice' END AS hash FROM part""")
def _(spark, sf):
    v = F.concat(F.lit("1."), F.col("p_size").cast("string"), F.when(
        F.col("p_partkey") % 2 == 0, F.concat(F.lit("+h+"), F.col("p_partkey").cast("string"))).otherwise(""))
    return W.table(spark, sf, "part").select("p_partkey", T.manifest_version_parts(v).alias("v")).select("p_partkey", "v.semver", "v.hash")


_ENTRY_CLASS = [W.LINE_PARTS, W.COMPONENTS, W.ENTRIES, W.BENCHMARK_WORDS, W.ENTRY_SYMBOLS]


def entry_arrays(spark, sf):
    """Entries in document form: each with its own array of vulnerable symbols."""
    item = F.struct(F.col("symbol").alias("name"), "confidence", "dynsym_export_verified")
    return W.entry_symbols(spark, sf).groupBy("component", "cve").agg(F.array_sort(F.collect_list(item)).alias("vulnerable_symbols"))


@query("f42_confidence_class", Q.select(_ENTRY_CLASS, """
SELECT component, cve, CASE WHEN bool_or(confidence = 'definitive') THEN 'definitive' ELSE 'probable' END AS class FROM entry_symbols GROUP BY component, cve"""))
def _(spark, sf):
    return entry_arrays(spark, sf).select("component", "cve", V.confidence_class(F.col("vulnerable_symbols")).alias("class"))


@query("p04_definitive_symbols", Q.select(_ENTRY_CLASS, """
SELECT component, cve, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (WHERE confidence = 'definitive'), '') AS definitive,
  bool_and(confidence = 'definitive') AS allows_clearing,
  coalesce(bool_and(dynsym_export_verified) FILTER (WHERE confidence = 'definitive'), FALSE) AS export_verified
FROM entry_symbols GROUP BY component, cve"""))
def _(spark, sf):
    s = F.col("vulnerable_symbols")
    return entry_arrays(spark, sf).select(
        "component", "cve", F.array_join(V.definitive_names(s), ",").alias("definitive"),
        V.allows_clearing(s).alias("allows_clearing"), V.export_verified(s).alias("export_verified"))


@query("p05_entries_that_allow_clearing", Q.select(_ENTRY_CLASS, """
SELECT component, count(*) FILTER (WHERE ok) AS allowed, count(*) AS n
FROM (SELECT component, cve, bool_and(confidence = 'definitive') AS ok FROM entry_symbols GROUP BY component, cve) GROUP BY component"""))
def _(spark, sf):
    return entry_arrays(spark, sf).groupBy("component").agg(
        F.count_if(V.allows_clearing(F.col("vulnerable_symbols"))).alias("allowed"), F.count(F.lit(1)).alias("n"))


@query("p11_export_verified_entries", Q.select(_ENTRY_CLASS, """
SELECT count(*) FILTER (WHERE ok) AS verified, count(*) AS n FROM (SELECT
  coalesce(bool_and(dynsym_export_verified) FILTER (WHERE confidence = 'definitive'), FALSE) AS ok FROM entry_symbols GROUP BY component, cve)"""))
def _(spark, sf):
    return entry_arrays(spark, sf).agg(
        F.count_if(V.export_verified(F.col("vulnerable_symbols"))).alias("verified"), F.count(F.lit(1)).alias("n"))


@query("f43_identity_of_purls", Q.select([*_UP, W.ALIASES], f"""
SELECT component_purl, CASE WHEN ok AND type NOT IN ('deb','apk','rpm') THEN name ELSE source END AS identity_source,
  CASE WHEN ok AND type NOT IN ('deb','apk','rpm') THEN 'direct' ELSE coalesce(status, 'none') END AS identity_status,
  CASE WHEN ok AND type NOT IN ('deb','apk','rpm') THEN name ELSE component END AS identity_component
FROM (SELECT *, {_UP_NAME} AS source FROM upstreams) u LEFT JOIN aliases a ON u.source = a.source_name"""))
def _(spark, sf):
    return R.identity_of_purls(W.findings(spark, sf), W.aliases(spark, sf))


@query("f44_slice_hash", Q.select([W.COMPONENTS], """
SELECT component, sha256(to_json({'component': component, 'ecosystem': ecosystem, 'provenance_status': provenance_status})) AS slice_hash FROM components"""))
def _(spark, sf):
    return W.components(spark, sf).select(
        "component", F.sha2(F.to_json(F.struct("component", "ecosystem", "provenance_status")), 256).alias("slice_hash"))


@query("f45_gnu_build_ids", """
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN md5(p_name) END AS build_id FROM part""")
def _(spark, sf):
    kind = F.when(F.col("p_partkey") % 3 == 0, "01000000").otherwise("03000000")
    note = F.unhex(F.concat(F.lit("0400000010000000"), kind, F.lit("474E5500"), F.md5("p_name")))
    return W.table(spark, sf, "part").select("p_partkey", S.gnu_build_id(note).alias("build_id"))


@query("p03_statement_ids", Q.select([W.FINDINGS], "SELECT DISTINCT cve, replace(lower(cve), ':', '-') AS statement_id FROM findings"))
def _(spark, sf):
    return W.findings(spark, sf).select("cve").distinct().withColumn("statement_id", T.statement_id(F.col("cve")))


@query("p06_inventory_ids", Q.select([W.INVENTORIES], """
SELECT CASE WHEN stripped THEN sha256 ELSE path END AS inventory_id, count(*) AS n FROM inventories GROUP BY 1"""))
def _(spark, sf):
    path = F.when(~F.col("stripped"), F.col("path")).otherwise("")
    return W.inventories(spark, sf).groupBy(S.inventory_id(path, F.col("sha256")).alias("inventory_id")).agg(F.count(F.lit(1)).alias("n"))


@query("p07_usable_symbol_tables", Q.select([W.INVENTORIES], """
SELECT inventory_id, format <> 'unknown' AND NOT (stripped AND static_linked) AND (has_dynamic OR (NOT stripped AND has_table)) AS usable,
  stripped AND has_dynamic AS dynamic_only FROM inventories"""))
def _(spark, sf):
    flags = [F.col(c) for c in ("format", "stripped", "static_linked", "has_dynamic", "has_table")]
    return W.inventories(spark, sf).select(
        "inventory_id", S.usable_symbol_table(*flags).alias("usable"),
        S.dynamic_only(F.col("stripped"), F.col("has_dynamic")).alias("dynamic_only"))


@query("p08_dynamic_only_binaries", Q.select([W.INVENTORIES], """
SELECT artifact_id, count(*) FILTER (WHERE stripped AND has_dynamic) AS n FROM inventories GROUP BY artifact_id"""))
def _(spark, sf):
    return W.inventories(spark, sf).groupBy("artifact_id").agg(
        F.count_if(S.dynamic_only(F.col("stripped"), F.col("has_dynamic"))).alias("n"))


@query("p09_distro_purls", Q.select(_PARSED, """
SELECT type, type IN ('deb','apk','rpm') AS distro, version <> '' AS pinned, count(*) AS n FROM parsed_findings WHERE ok GROUP BY ALL"""))
def _(spark, sf):
    p = F.col("purl")
    return parsed(spark, sf).where(p.isNotNull()).groupBy(
        p["type"].alias("type"), P.is_distro(p).alias("distro"), P.has_version(p).alias("pinned")).agg(F.count(F.lit(1)).alias("n"))


@query("p10_verified_components", Q.select([W.COMPONENTS], "SELECT component FROM components WHERE provenance_status = 'verified'"))
def _(spark, sf):
    return W.components(spark, sf).where(F.coalesce("provenance_status", F.lit("unverified")) == "verified").select("component")


@query("p13_versioned_purls", Q.select(_PARSED, "SELECT component_purl, ok AND version <> '' AS versioned FROM parsed_findings"))
def _(spark, sf):
    return parsed(spark, sf).select("component_purl", P.has_version(F.col("purl")).alias("versioned"))


@query("p14_c_family_paths", """
SELECT p_partkey, p_partkey % 4 < 2 AS c_family FROM part""")
def _(spark, sf):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".C", ".hpp", ".py", ".c.txt")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return W.table(spark, sf, "part").select("p_partkey", T.is_c_family(F.concat(F.lit("src/"), F.col("p_name"), ext)).alias("c_family"))


@query("o04_sorted_symbols", Q.select([W.INVENTORIES, W.SYMBOLS], """
SELECT inventory_id, sha256(string_agg(normalized || ':' || raw, ',' ORDER BY normalized, raw)) AS digest FROM symbols GROUP BY inventory_id"""))
def _(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("normalized", "raw")))
    text = F.array_join(F.transform(ordered, lambda s: F.concat(s["normalized"], F.lit(":"), s["raw"])), ",")
    return W.symbols(spark, sf).groupBy("inventory_id").agg(F.sha2(text, 256).alias("digest"))


@query("u01_observable_symbols", Q.select([W.INVENTORIES, W.SYMBOLS], """
SELECT artifact_id, count(DISTINCT symbol) AS n FROM (SELECT artifact_id, raw AS symbol FROM symbols UNION ALL SELECT artifact_id, normalized FROM symbols) GROUP BY artifact_id"""))
def _(spark, sf):
    from clearwright.operators.decide import observable

    return observable(W.symbols(spark, sf)).select("artifact_id", "symbol").distinct().groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))


@query("u04_ordered_unique", """
SELECT doc_id, len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: x <> ''))) AS n FROM documents""")
def _(spark, sf):
    unique = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: x != ""))
    return W.table(spark, sf, "documents").select("doc_id", F.size(unique).cast("bigint").alias("n"))


@query("u05_identity_hit_kinds", Q.select(Q.MEMBERS, "SELECT component, kind, count(*) AS n FROM members GROUP BY component, kind"))
def _(spark, sf):
    from clearwright.operators.decide import identity_hits
    from clearwright.plans.decisions import binary_facts, catalogue

    return identity_hits(binary_facts(spark, sf), catalogue(spark, sf)).groupBy("component", "kind").agg(F.count(F.lit(1)).alias("n"))
