"""Audit of third-party VEX statements against bills of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.functions import purl as P

# Component types that are products of their own.
PRODUCT_TYPES = ("application", "container", "firmware", "device")


def root_flags(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Add `is_root`: the described product, or a product type nobody depends on.

    `components` has sbom_id, bom_ref, type, is_metadata; `edges` sbom_id, child_ref.
    Only whether somebody depends on a component matters, so there is no traversal.
    """
    children = edges.select("sbom_id", F.col("child_ref").alias("bom_ref"), F.lit(True).alias("__needed")).distinct()
    needed = F.coalesce("__needed", F.lit(False))
    named = components.where("is_metadata").select(
        "sbom_id", "bom_ref", F.lit(True).alias("__named")).where(F.coalesce("bom_ref", F.lit("")) != "").distinct()
    joined = components.join(children, ["sbom_id", "bom_ref"], "left").join(named, ["sbom_id", "bom_ref"], "left")
    product = F.coalesce(F.col("type").isin(*PRODUCT_TYPES), F.lit(False))
    root = F.col("is_metadata") | (~needed & (F.coalesce("__named", F.lit(False)) | product))
    return joined.withColumn("is_root", root).drop("__needed", "__named")


def is_suppression(status: Column) -> Column:
    """Only an empty or not-affected status suppresses findings."""
    return F.coalesce(status, F.lit("")).isin("", "known_not_affected")


def graded_matches(products: DataFrame, components: DataFrame) -> DataFrame:
    """Product PURLs against the components of the same bill, by name, none dropped.

    `products` has statement_id, sbom_id, product (struct); `components` sbom_id, purl (struct), is_root.
    """
    own = products.withColumn("__name", F.col("product.name"))
    theirs = components.select("sbom_id", F.col("purl.name").alias("__name"), "purl", "is_root")
    rank = P.match_quality(F.col("product"), F.col("purl"))
    return own.join(theirs, ["sbom_id", "__name"]).select(
        "statement_id", "sbom_id", F.col("product.canonical").alias("product"),
        F.col("purl.canonical").alias("component"), "is_root", rank.alias("quality"),
    ).where(F.col("quality") > P.NONE)


def audit(statements: DataFrame, components: DataFrame) -> DataFrame:
    """Status of every statement: ok, inert, overbroad or versionless.

    `statements` has statement_id, sbom_id, status and the array `products`.
    """
    rows = statements.where(is_suppression(F.col("status"))).select("statement_id", "sbom_id", F.explode("products").alias("product_text"))
    own = P.with_parsed_purl(rows, "product_text", "product").withColumn("__name", F.col("product.name"))
    theirs = components.select("sbom_id", F.col("purl.name").alias("__name"), "purl", "is_root")
    rank = P.match_quality(F.col("product"), F.col("purl"))
    strong = F.coalesce(rank >= P.TYPE_NORMALIZED, F.lit(False))
    hits = own.join(theirs, ["sbom_id", "__name"], "left").groupBy("statement_id").agg(
        F.bool_or(~P.has_version(F.col("product"))).alias("versionless"), F.max(rank).alias("best"),
        F.count_if(strong & F.col("is_root")).alias("root_hits"), F.count_if(strong & ~F.col("is_root")).alias("sub_hits"))
    joined = statements.drop("products").join(hits, "statement_id", "left")
    best, sub, root = (F.coalesce(c, F.lit(0)) for c in ("best", "sub_hits", "root_hits"))
    versionless = F.coalesce("versionless", F.lit(False))
    outcome = (
        F.when(~is_suppression(F.col("status")), "ok").when(versionless, "versionless")
        .when(best < P.TYPE_NORMALIZED, "inert").when((sub > 0) & (root == 0), "overbroad").otherwise("ok")
    )
    graded = is_suppression(F.col("status")) & ~versionless
    return joined.select(
        "statement_id", "sbom_id", "status", F.when(graded, best).otherwise(0).alias("best"),
        F.when(graded, root).otherwise(0).alias("root_hits"), F.when(graded, sub).otherwise(0).alias("sub_hits"),
        outcome.alias("audit_status"))


def has_failures(audited: DataFrame) -> DataFrame:
    """One row: is any statement inert, overbroad or versionless?"""
    return audited.agg(
        F.count(F.lit(1)).alias("statements"),
        F.coalesce(F.bool_or(F.col("audit_status").isin("inert", "overbroad", "versionless")), F.lit(False)).alias("failed"))
