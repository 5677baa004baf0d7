"""Scanner reports and vulnerability dumps as findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.functions import purl as P
from clearwright.functions.text import blank_to_null, strip_space
from clearwright.sources.documents import is_list

GRYPE = ("matches ARRAY<STRUCT<vulnerability: STRUCT<id: STRING>, artifact: STRUCT<id: STRING, purl: STRING, "
         "name: STRING, version: STRING, upstreams: ARRAY<STRUCT<name: STRING>>>>>")
TRIVY = ("Results ARRAY<STRUCT<Vulnerabilities: ARRAY<STRUCT<VulnerabilityID: STRING, PkgIdentifier: "
         "STRUCT<PURL: STRING>, PkgName: STRING>>, Packages: ARRAY<STRUCT<Name: STRING, SrcName: STRING>>>>")
CVE_BIN_TOOL = "ARRAY<STRUCT<cve: STRING, purl: STRING, name: STRING>>"
OSV = "id STRING, affected ARRAY<STRUCT<package: STRUCT<ecosystem: STRING, name: STRING>>>"

# Vulnerability-dump ecosystem names (lower case) and their PURL types.
ECOSYSTEM_TYPES = {
    "debian": "deb", "ubuntu": "deb", "alpine": "apk", "red hat": "rpm", "rocky linux": "rpm",
    "almalinux": "rpm", "go": "golang", "crates.io": "cargo", "rubygems": "gem", "packagist": "composer",
}


def _or_named(purl: Column, name: Column) -> Column:
    """The PURL, or a generic one from the bare name."""
    return F.coalesce(blank_to_null(purl), F.concat(F.lit("pkg:generic/"), blank_to_null(name)))


def _pairs(items: Column, cve, purl) -> Column:
    return F.transform(items, lambda i: F.struct(cve(i).alias("cve"), purl(i).alias("component_purl")))


def grype_pairs(matches: Column) -> Column:
    return _pairs(matches, lambda m: m["vulnerability"]["id"], lambda m: m["artifact"]["purl"])


def trivy_pairs(results: Column) -> Column:
    vulnerabilities = F.flatten(F.transform(results, lambda r: F.coalesce(r["Vulnerabilities"], F.array())))
    return _pairs(vulnerabilities, lambda v: v["VulnerabilityID"],
                  lambda v: _or_named(v["PkgIdentifier"]["PURL"], v["PkgName"]))


def cve_bin_tool_pairs(items: Column) -> Column:
    return _pairs(items, lambda i: i["cve"], lambda i: _or_named(i["purl"], i["name"]))


def scan_format(report: Column, listed: Column) -> Column:
    """Report format by its keys: an empty grype list does not hide a Trivy report."""
    return (
        F.when(listed, "cve-bin-tool").when(report["matches"].isNotNull(), "grype")
        .when(report["Results"].isNotNull(), "trivy").otherwise("unrecognized")
    )


def load_findings(docs: DataFrame) -> DataFrame:
    """Raw findings of mixed scanner reports, one JSON parse per document."""
    parsed = docs.select(
        F.col("doc_id").alias("artifact_id"),
        F.when(~is_list(), F.from_json("content", f"STRUCT<{_nested(GRYPE)}, {_nested(TRIVY)}>")).alias("report"),
        F.when(is_list(), F.from_json("content", CVE_BIN_TOOL)).alias("items"),
        is_list().alias("listed"),
    )
    none = F.expr("CAST(array() AS ARRAY<STRUCT<cve: STRING, component_purl: STRING>>)")
    pairs = F.concat(
        F.coalesce(grype_pairs(F.col("report.matches")), none),
        F.coalesce(trivy_pairs(F.col("report.Results")), none),
        F.coalesce(cve_bin_tool_pairs(F.col("items")), none),
    )
    return parsed.select(
        "artifact_id", scan_format(F.col("report"), F.col("listed")).alias("format"), F.inline(pairs))


def unrecognized(docs: DataFrame) -> DataFrame:
    """Documents of no known scanner format."""
    report = F.from_json("content", f"STRUCT<{_nested(GRYPE)}, {_nested(TRIVY)}>")
    items = F.from_json("content", CVE_BIN_TOOL)
    marked = docs.withColumn("__listed", is_list()).select(
        "doc_id", F.when(F.col("__listed") & items.isNull(), "unrecognized")
        .otherwise(scan_format(report, F.col("__listed"))).alias("format"))
    return marked.where(F.col("format") == "unrecognized").select("doc_id")


def _nested(ddl: str) -> str:
    """`name TYPE` as the `name: TYPE` of a nested struct."""
    name, kind = ddl.split(" ", 1)
    return f"{name}: {kind}"


def osv_keys(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, vulnerability) from a JSON-lines dump; unreadable lines and empty ids are skipped.

    The key is `type/name` with the ecosystem mapped to its PURL type.
    """
    eco = F.lower("eco")
    kind = eco
    for name, ptype in ECOSYSTEM_TYPES.items():
        kind = F.when(eco == name, F.lit(ptype)).otherwise(kind)
    return (
        lines.select(F.from_json(column, OSV).alias("r"))
        .select(F.upper(strip_space(F.col("r.id"))).alias("vulnerability"), F.explode("r.affected").alias("a"))
        .where(F.coalesce("vulnerability", F.lit("")) != "")
        .select("vulnerability", F.col("a.package.ecosystem").alias("eco"), F.col("a.package.name").alias("name"))
        .select(F.concat(kind, F.lit("/"), F.col("name")).alias("key"), "vulnerability")
        .where(F.col("key").isNotNull()).distinct()
    )


def _purl_matches(components: DataFrame, keys: DataFrame) -> DataFrame:
    """(component_purl, vulnerability): distinct component PURLs with the vulnerabilities of their dump keys."""
    p = F.col("purl")
    short = F.concat(p["type"], F.lit("/"), p["name"])
    full = F.concat(p["type"], F.lit("/"), p["namespace"], F.lit("/"), p["name"])
    own = F.array_distinct(F.array(p["canonical"], short, F.when(p["namespace"] != "", full).otherwise(short)))
    distinct = components.select(p["canonical"].alias("component_purl"), own.alias("own")).where("component_purl IS NOT NULL").distinct()
    return distinct.select("component_purl", F.explode("own").alias("key")).join(keys, "key").select("component_purl", "vulnerability").distinct()


def osv_findings(components: DataFrame, keys: DataFrame) -> DataFrame:
    """Components (sbom_id, purl struct) against dump keys: name, or namespace and name; versions are not checked.

    Keys are looked up for distinct PURLs, which then meet the bills.
    """
    bills = components.select("sbom_id", F.col("purl.canonical").alias("component_purl")).distinct()
    return bills.join(_purl_matches(components, keys), "component_purl").select(
        F.col("sbom_id").alias("artifact_id"), F.col("vulnerability").alias("cve"), "component_purl", F.lit(False).alias("version_checked"))


def without_osv_key(components: DataFrame, keys: DataFrame) -> DataFrame:
    """(artifact_id, reason): bills of which no component matches any key, so an empty result is told from a clean one."""
    matched = _purl_matches(components, keys).select(F.col("component_purl").alias("__hit")).distinct()
    seen = components.select("sbom_id", F.col("purl.canonical").alias("p")).join(matched, F.col("p") == F.col("__hit"), "left")
    return seen.groupBy(F.col("sbom_id").alias("artifact_id")).agg(F.count("__hit").alias("n")).where("n = 0").select(
        "artifact_id", F.lit("no component matches a key of the dump").alias("reason"))


def scanner_metadata(docs: DataFrame) -> DataFrame:
    """Scanner name, version and database build, with the key fallbacks seen in the wild."""
    def first_of(*paths: str) -> Column:
        return F.coalesce(*[blank_to_null(F.get_json_object("content", f"$.descriptor.{p}")) for p in paths])

    return docs.select(
        "doc_id", first_of("name").alias("scanner"), first_of("version").alias("version"),
        first_of("db.built", "db.built_at", "db.timestamp", "db.schema", "database.built", "database.built_at",
                 "database.timestamp", "database.schema").alias("database_built"))


def consumer_counts(docs: DataFrame) -> DataFrame:
    """Per scan document: unique vulnerabilities, packages, and packages whose source name differs.

    A Grype document without a package list falls back to the distinct matched artifacts.
    """
    schema = (f"STRUCT<{_nested(GRYPE)}, {_nested(TRIVY)}, alertsByPackage: ARRAY<STRUCT<package: STRUCT<name: STRING, "
              "upstreams: ARRAY<STRUCT<name: STRING>>>>>>")
    r = docs.select("doc_id", F.from_json("content", schema).alias("r"))
    trivy_packages = F.flatten(F.transform("r.Results", lambda x: F.coalesce(x["Packages"], F.array())))
    trivy_ids = F.transform(
        F.flatten(F.transform("r.Results", lambda x: F.coalesce(x["Vulnerabilities"], F.array()))),
        lambda v: v["VulnerabilityID"])
    ids = F.coalesce(trivy_ids, F.transform("r.matches", lambda m: m["vulnerability"]["id"]))
    artifacts = F.transform("r.matches", lambda m: F.struct(
        F.coalesce(blank_to_null(m["artifact"]["id"]), blank_to_null(m["artifact"]["purl"]), m["artifact"]["name"]).alias("key"),
        m["artifact"]["version"].alias("version"), m["artifact"]["name"].alias("name"),
        F.transform(m["artifact"]["upstreams"], lambda u: u["name"]).alias("sources")))
    listed = F.transform("r.alertsByPackage", lambda e: F.struct(
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("version"),
        e["package"]["name"].alias("name"), F.transform(e["package"]["upstreams"], lambda u: u["name"]).alias("sources")))
    distinct = F.filter(artifacts, lambda a, i: ~F.exists(
        F.slice(artifacts, i + 2, F.size(artifacts)), lambda b: (b["key"] == a["key"]) & b["version"].eqNullSafe(a["version"])))
    grype = F.when(F.coalesce(F.size("r.alertsByPackage"), F.lit(0)) > 0, listed).otherwise(distinct)
    trivy = F.transform(trivy_packages, lambda p: F.struct(
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("version"), p["Name"].alias("name"),
        F.array_compact(F.array(blank_to_null(p["SrcName"]))).alias("sources")))
    packages = F.when(F.col("r.Results").isNotNull(), trivy).otherwise(grype)
    differs = F.filter(packages, lambda p: F.exists(
        F.coalesce(p["sources"], F.array().cast("array<string>")), lambda s: s != p["name"]))
    return r.select(
        "doc_id", F.size(F.array_distinct(F.filter(ids, lambda x: F.coalesce(x, F.lit("")) != ""))).cast("bigint").alias("unique_vulns"),
        F.size(packages).cast("bigint").alias("packages_observed"), F.size(differs).cast("bigint").alias("src_ne_binary"))
