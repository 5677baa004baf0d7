"""CycloneDX and SPDX bills of materials as component rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.functions import purl as P
from clearwright.functions.text import blank_to_null
from clearwright.operators.audit import root_flags

_COMPONENT = "STRUCT<`bom-ref`: STRING, type: STRING, name: STRING, version: STRING, purl: STRING, properties: ARRAY<STRUCT<name: STRING, value: STRING>>>"
CYCLONEDX = (f"bomFormat STRING, metadata STRUCT<component: {_COMPONENT}>, components ARRAY<{_COMPONENT}>, "
             "dependencies ARRAY<STRUCT<ref: STRING, dependsOn: ARRAY<STRING>>>")
SPDX = ("spdxVersion STRING, packages ARRAY<STRUCT<name: STRING, SPDXID: STRING, externalRefs: "
        "ARRAY<STRUCT<referenceType: STRING, referenceCategory: STRING, referenceLocator: STRING>>>>, "
        "relationships ARRAY<STRUCT<relationshipType: STRING, spdxElementId: STRING, relatedSpdxElement: STRING>>")


def sbom_format(content: Column) -> Column:
    return (
        F.when(F.get_json_object(content, "$.bomFormat").isNotNull(), "cyclonedx")
        .when(F.get_json_object(content, "$.spdxVersion").isNotNull(), "spdx").otherwise("unrecognized")
    )


def cyclonedx_components(docs: DataFrame) -> DataFrame:
    """(sbom_id, name, purl_text, is_root) of CycloneDX documents; components without PURL are skipped."""
    d = docs.select(F.col("doc_id").alias("sbom_id"), F.from_json("content", CYCLONEDX).alias("d"))
    top = d.select("sbom_id", F.col("d.metadata.component").alias("c"), F.lit(True).alias("is_metadata")).where(
        F.col("c").isNotNull())
    listed = d.select("sbom_id", F.explode("d.components").alias("c"), F.lit(False).alias("is_metadata"))
    rows = top.unionByName(listed).select(
        "sbom_id", "is_metadata", F.col("c.`bom-ref`").alias("bom_ref"), F.col("c.type").alias("type"),
        F.col("c.name").alias("name"), blank_to_null(F.col("c.purl")).alias("purl_text"))
    edges = d.select("sbom_id", F.explode("d.dependencies").alias("e")).select(
        "sbom_id", F.explode("e.dependsOn").alias("child_ref"))
    return root_flags(rows, edges).where(F.col("purl_text").isNotNull()).select("sbom_id", "name", "purl_text", "is_root")


def spdx_components(docs: DataFrame) -> DataFrame:
    """As above for SPDX: roots are DESCRIBES targets, or the first package when nothing is described."""
    d = docs.select(F.col("doc_id").alias("sbom_id"), F.from_json("content", SPDX).alias("d"))
    with_purl = F.filter(F.transform("d.packages", lambda p: F.struct(
        p["name"].alias("name"), p["SPDXID"].alias("ref"),
        blank_to_null(F.try_element_at(F.filter(p["externalRefs"], lambda r: r["referenceType"] == "purl"), F.lit(1))
                      ["referenceLocator"]).alias("purl_text"))), lambda p: p["purl_text"].isNotNull())
    rows = d.select("sbom_id", F.posexplode(with_purl).alias("pos", "p")).select("sbom_id", "pos", "p.*")
    described = (
        d.select("sbom_id", F.explode("d.relationships").alias("r"))
        .where((F.col("r.relationshipType") == "DESCRIBES") & (F.col("r.spdxElementId") == "SPDXRef-DOCUMENT"))
        .select("sbom_id", F.col("r.relatedSpdxElement").alias("ref"), F.lit(True).alias("hit")).distinct()
    )
    any_described = described.select("sbom_id", F.lit(True).alias("some")).distinct()
    return rows.join(described, ["sbom_id", "ref"], "left").join(any_described, "sbom_id", "left").select(
        "sbom_id", "name", "purl_text",
        (F.coalesce("hit", F.lit(False)) | (F.col("some").isNull() & (F.col("pos") == 0))).alias("is_root"))


def load_sboms(docs: DataFrame) -> DataFrame:
    """Components of mixed documents, routed by their keys, with the parsed PURL; `unrecognized` has the rest."""
    marked = docs.withColumn("__format", sbom_format(F.col("content")))
    rows = cyclonedx_components(marked.where(F.col("__format") == "cyclonedx")).unionByName(
        spdx_components(marked.where(F.col("__format") == "spdx")))
    return P.with_parsed_purl(rows, "purl_text")


def unrecognized(docs: DataFrame) -> DataFrame:
    """(doc_id, reason): documents that `load_sboms` cannot route."""
    known = sbom_format(F.col("content")) != "unrecognized"
    return docs.where(~F.coalesce(known, F.lit(False))).select("doc_id", F.lit("no known bill of materials").alias("reason"))


def sbom_counts(docs: DataFrame) -> DataFrame:
    """Raw package counts per document: total, with PURL, distinct PURLs."""
    d = docs.select(
        "doc_id", sbom_format(F.col("content")).alias("format"), F.from_json("content", CYCLONEDX).alias("c"),
        F.from_json("content", SPDX).alias("s"))
    listed = F.transform("c.components", lambda x: blank_to_null(x["purl"]))
    has = F.filter("s.packages", lambda p: F.exists(
        p["externalRefs"], lambda r: (r["referenceType"] == "purl") | (r["referenceCategory"] == "PACKAGE-MANAGER")))
    refs = F.flatten(F.transform("s.packages", lambda p: F.coalesce(F.transform(
        F.filter(p["externalRefs"], lambda r: r["referenceType"] == "purl"), lambda r: r["referenceLocator"]), F.array())))
    cdx = F.col("format") == "cyclonedx"
    packages = F.when(cdx, F.size("c.components")).otherwise(F.size("s.packages"))
    found = F.when(cdx, F.array_compact(listed)).otherwise(refs)
    return d.select(
        "doc_id", "format", packages.cast("bigint").alias("total"),
        F.when(cdx, F.size(F.array_compact(listed))).otherwise(F.size(has)).cast("bigint").alias("with_purl"),
        F.size(F.array_distinct(found)).cast("bigint").alias("purls"))


def with_source_names(components: Column) -> Column:
    """Add source name and version properties to components that carry properties."""
    def enriched(c: Column) -> Column:
        known = F.try_element_at(F.filter(c["properties"], lambda p: p["name"] == "syft:metadata:source"), F.lit(1))
        added = F.array(
            F.struct(F.lit("aquasecurity:trivy:SrcName").alias("name"), F.coalesce(known["value"], c["name"]).alias("value")),
            F.struct(F.lit("aquasecurity:trivy:SrcVersion").alias("name"), c["version"].alias("value")))
        return F.when(c["properties"].isNotNull(), c.withField("properties", F.concat(c["properties"], added))).otherwise(c)

    return F.transform(components, enriched)
