"""Readers of the corpus files: catalogue, curated data, decisions, summaries, bundles, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwright.functions.text import blank_to_null, strip_space
from clearwright.sources.documents import broken_documents, broken_lines, read_documents, read_json_lines

SYMBOL = ("STRUCT<name: STRING, confidence: STRING, dynsym_export_verified: BOOLEAN, provenance: STRUCT<upstream_fix_commit: STRING, "
          "derivation: STRING, reviewed_by: STRING, reviewed_at: STRING>>")
MANIFEST = ("component STRUCT<name: STRING, ecosystem: STRING, provenance_status: STRING, purls: ARRAY<STRING>, identity_symbols: ARRAY<STRING>, "
            f"identity_strings: ARRAY<STRING>>, entries ARRAY<STRUCT<cve: STRING, affected_versions: ARRAY<STRING>, vulnerable_symbols: ARRAY<{SYMBOL}>, "
            "notes: STRING, manifest_version: STRING>>")
ALIASES = ("aliases ARRAY<STRUCT<source_name: STRING, component: STRING, status: STRING, provenance: STRUCT<artifact_sha256: STRING, distro: STRING, "
           "package_name: STRING, package_version: STRING, verified_at: STRING, binary_path: STRING, identity_symbols_verified: ARRAY<STRING>, "
           "extraction_method: STRING, reviewed_by: STRING>>>")
DECISION = ("cve STRING, component_purl STRING, verdict STRING, rule_id STRING, reason_code STRING, justification STRING, component STRING, "
            "statement_id STRING, evidence_bundle STRING")
SUMMARY = ("binaries_scanned BIGINT, stripped BIGINT, static_linked BIGINT, cves_in BIGINT, not_affected BIGINT, affected BIGINT, refused BIGINT, "
           "coverage_percent BIGINT, refused_breakdown MAP<STRING, BIGINT>, integrity_refusals MAP<STRING, BIGINT>, success BOOLEAN")
LABEL = ("id STRING, cve STRING, component STRING, component_purl STRING, artifact STRING, artifact_class STRING, pipeline_verdict STRING, "
         "rule_id STRING, reason_code STRING, justification STRING, human_label STRING")
CATALOGUE = ("id STRING, class STRING, ref STRING, url STRING, path STRING, source_url STRING, sha256 STRING, fetched_at STRING, status STRING")
ARTIFACT_FOLDER = r"([^/]+)/[^/]+$"


def load_manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """Component documents (JSON) under `path`, one row per file."""
    docs = read_documents(spark, path, r"(components/.*|candidates/.*|[^/]+)$")
    return manifest_documents(docs.where(F.lower("doc_id").endswith(".json")))


def manifest_documents(docs: DataFrame) -> DataFrame:
    """Parsed documents; text that is no such document fails the job, as curated data must be whole."""
    parsed = F.from_json("content", MANIFEST, {"mode": "FAILFAST"})
    return docs.select(F.col("doc_id").alias("source_file"), parsed.alias("d")).select("source_file", "d.component", "d.entries")


def manifest_tables(files: DataFrame) -> dict[str, DataFrame]:
    """The curated relations of `decide` from manifest files; list order becomes positions."""
    c = F.col("component")
    name = c["name"].alias("component")
    entries = files.select("source_file", name, c["ecosystem"].alias("ecosystem"), F.posexplode("entries").alias("entry_pos", "e")).select(
        "source_file", "component", "ecosystem", "entry_pos", "e.*")
    # Several entries for one (component, cve): the first in load order counts.
    first = entries.groupBy("component", F.upper(strip_space(F.col("cve"))).alias("cve")).agg(
        F.min(F.struct("source_file", "entry_pos", "vulnerable_symbols")).alias("f"))
    return {
        "components": files.select(
            name, c["ecosystem"].alias("ecosystem"), "source_file",
            F.coalesce(blank_to_null(c["provenance_status"]), F.lit("unverified")).alias("provenance_status")),
        "component_purls": files.select(name, "source_file", F.posexplode(c["purls"]).alias("purl_pos", "purl_text")),
        "identity_symbols": files.select(name, F.posexplode(c["identity_symbols"]).alias("position", "symbol")),
        "identity_strings": files.select(name, F.posexplode(c["identity_strings"]).alias("position", "pattern")),
        "entries": first.select("component", "cve"),
        "entry_symbols": first.select("component", "cve", F.explode("f.vulnerable_symbols").alias("s")).select(
            "component", "cve", F.col("s.name").alias("symbol"), F.col("s.confidence").alias("confidence"),
            F.coalesce("s.dynsym_export_verified", F.lit(False)).alias("dynsym_export_verified")),
    }


def alias_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.from_json("content", ALIASES)["aliases"]).alias("a")).select("a.*")


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    return alias_rows(read_documents(spark, path))


def catalogue_rows(docs: DataFrame) -> DataFrame:
    """Catalogue documents (JSON text) as artifact rows."""
    nested = ", ".join(part.strip().replace(" ", ": ", 1) for part in CATALOGUE.split(","))
    parsed = F.from_json("content", f"artifacts ARRAY<STRUCT<{nested}>>")
    return docs.select(F.explode(parsed["artifacts"]).alias("a")).select(F.col("a.id").alias("artifact_id"), "a.*").drop("id")


def load_decisions(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """`<artifact>/decisions.jsonl` files; the artifact id is the folder name.  A malformed line fails the job unless skipped."""
    return read_json_lines(spark, f"{path}/*/decisions.jsonl", DECISION, ARTIFACT_FOLDER, skip_broken)


def broken_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Malformed decision lines with their artifact and reason."""
    return broken_lines(spark, f"{path}/*/decisions.jsonl", DECISION, ARTIFACT_FOLDER)


def broken(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, reason): documents that the reader of `kind` (aliases, catalogue, labels, summary) cannot parse."""
    nested = {"catalogue": ("artifacts", CATALOGUE), "labels": ("statements", LABEL)}
    if kind in nested:
        name, fields = nested[kind]
        return broken_documents(docs, f"{name} ARRAY<STRUCT<{', '.join(x.strip().replace(' ', ': ', 1) for x in fields.split(','))}>>")
    return broken_documents(docs, {"aliases": ALIASES, "summary": SUMMARY}[kind])


def load_summaries(spark: SparkSession, path: str) -> DataFrame:
    """`<artifact>/scan-summary.json` files; empty and malformed files are skipped."""
    docs = read_documents(spark, f"{path}/*/scan-summary.json", ARTIFACT_FOLDER)
    return summary_rows(docs)


def summary_rows(docs: DataFrame) -> DataFrame:
    parsed = docs.select(F.col("doc_id").alias("artifact_id"), F.from_json("content", SUMMARY).alias("s"))
    return parsed.where(F.col("s.cves_in").isNotNull()).select("artifact_id", "s.*")


def label_rows(docs: DataFrame) -> DataFrame:
    nested = ", ".join(part.strip().replace(" ", ": ", 1) for part in LABEL.split(","))
    parsed = F.from_json("content", f"statements ARRAY<STRUCT<{nested}>>")
    return docs.select(F.explode(parsed["statements"]).alias("s")).select("s.*")


def statements_from_files(files: DataFrame) -> DataFrame:
    """Evidence files back into statements with their artifact hash, catalogue version and slices."""
    # The name is cut off from the end: a regex that looks for it tries every letter of the folder as its start.
    name = F.substring_index("path", "/", -1)
    inside = (name != "") & (F.length(name) < F.length("path"))
    folder = F.when(inside, F.left("path", F.length("path") - F.length(name) - 1)).otherwise(F.col("path"))

    def body(which: str) -> Column:
        return F.max(F.when(F.col("name") == which, F.col("body")))

    read = {"statement.json": "s", "inputs.json": "i", "versions.json": "v", "manifest-slice.json": "slice", "identity-slice.json": "identity_slice"}
    named = files.select("artifact_id", "body", name.alias("name"), folder.alias("folder"))
    grouped = named.where(F.col("name").isin(*read)).groupBy("artifact_id", "folder").agg(
        *(body(file).alias(column) for file, column in read.items()))
    s = F.from_json("s", "cve STRING, component_purl STRING, verdict STRING, justification STRING, rule_id STRING, reason_code STRING")
    return grouped.select(
        "artifact_id", "folder", s.alias("s"), F.get_json_object("i", "$.artifact_sha256").alias("artifact_sha256"),
        F.get_json_object("v", "$.manifest_version").alias("manifest_version"), "slice", "identity_slice").select(
        "artifact_id", "folder", "s.*", "artifact_sha256", "manifest_version", "slice", "identity_slice")


def inconsistent_artifacts(statements: DataFrame) -> DataFrame:
    """Artifacts whose statements name more than one artifact hash."""
    return statements.groupBy("artifact_id").agg(
        F.min(F.lower("artifact_sha256")).alias("low"), F.max(F.lower("artifact_sha256")).alias("high")).where("low <> high")


def checksum_lines(lines: DataFrame) -> DataFrame:
    """`<sha>  <path>` lines; comments and blanks are skipped, malformed lines are marked."""
    text = strip_space(F.col("value"))
    parts = F.split(text, r"\s+")
    return lines.where((text != "") & ~text.startswith("#")).select(
        F.when(F.size(parts) == 2, parts[0]).alias("sha256"), F.when(F.size(parts) == 2, parts[1]).alias("path"),
        (F.size(parts) != 2).alias("malformed"))
