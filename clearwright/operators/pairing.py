"""What SBOM producer-consumer pairs lose against a direct scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.functions import stats
from clearwright.functions.purl import type_of_text

# Material loss: everything gone, or at least this many ids, or this share.
MIN_LOST_IDS = 5
MIN_LOSS_PCT = 10.0


def distinct_counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct vulnerabilities per `keys`; the distinct step shuffles by the full key, so no hot group."""
    return hits.select(*keys, "vulnerability").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_vulns"))


def package_counts(packages: DataFrame, keys: list[str]) -> DataFrame:
    """Packages observed and those with a source name other than their own."""
    differs = F.exists("upstreams", lambda u: u != F.col("name"))
    return packages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packages_observed"), F.count_if(F.coalesce(differs, F.lit(False))).alias("src_ne_binary"))


def pairing_losses(cells: DataFrame, baselines: dict[str, str]) -> DataFrame:
    """Each cell next to its consumer's direct scan: delta, loss percent and the material flag.

    `cells` has image_id, advisory_model, cell, unique_vulns, src_ne_binary;
    `baselines` names the direct-scan cell per cell (a baseline maps to itself).
    """
    from clearwright.functions.verdict import lookup

    base_cell = lookup(F.col("cell"), baselines)
    base = cells.select(
        "image_id", F.col("cell").alias("baseline_cell"), F.col("unique_vulns").alias("baseline_vulns"),
        F.col("src_ne_binary").alias("baseline_src_ne_binary"))
    joined = cells.withColumn("baseline_cell", base_cell).join(base, ["image_id", "baseline_cell"])
    before, now = F.col("baseline_vulns"), F.col("unique_vulns")
    loss = F.when(before > 0, F.round(100.0 * (before - now) / before, 1)).when(now == 0, F.lit(0.0))
    material = (F.col("cell") != F.col("baseline_cell")) & (before > 0) & (
        (now == 0) | (before - now >= MIN_LOST_IDS) | (F.coalesce(loss, F.lit(0.0)) >= MIN_LOSS_PCT))
    return joined.select(
        "image_id", "advisory_model", "cell", "unique_vulns", "src_ne_binary", "baseline_cell", "baseline_vulns",
        "baseline_src_ne_binary", (now - before).alias("vuln_delta"), loss.alias("vuln_loss_pct"),
        F.when(material, "yes").otherwise("no").alias("material_loss"))


def loss_by_model(losses: DataFrame) -> DataFrame:
    scored = losses.where(F.col("cell") != F.col("baseline_cell"))
    mean = F.avg(F.when(F.col("baseline_vulns") > 0, F.col("vuln_loss_pct")))
    return scored.groupBy("advisory_model", "cell").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("material_loss") == "yes").alias("material"),
        F.round(F.coalesce(mean, F.lit(0.0)), 1).alias("mean_loss_pct"),
        F.round(F.avg("src_ne_binary"), 1).alias("mean_src_ne_binary"),
        F.round(F.avg("baseline_src_ne_binary"), 1).alias("mean_baseline_src_ne_binary"))


def class_verdict(losses: DataFrame) -> DataFrame:
    """Is the loss a class across consumers, one consumer's bug, or absent?"""
    hit = losses.where((F.col("material_loss") == "yes"))
    counted = hit.agg(F.countDistinct("baseline_cell").alias("consumers"), F.countDistinct("cell").alias("cells"))
    verdict = F.when(F.col("consumers") > 1, "multiple consumers").when(
        F.col("consumers") == 1, "single consumer").otherwise("none")
    return counted.select("consumers", "cells", verdict.alias("verdict"))


def newly_surfaced(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids only the second scan reports, with each PURL type they are reported against.

    One row per (id, type); both inputs have vulnerability and purl_text.
    """
    old = before.select("vulnerability").distinct()
    return (
        after.join(old, "vulnerability", "left_anti")
        .select("vulnerability", type_of_text(F.coalesce("purl_text", F.lit(""))).alias("purl_type")).distinct()
    )


def surfaced_classes(surfaced: DataFrame) -> DataFrame:
    """Ids by exclusive type; `mixed` when reported against several types."""
    per_id = surfaced.groupBy("vulnerability").agg(F.count(F.lit(1)).alias("n"), F.min("purl_type").alias("only"))
    kind = F.when(F.col("n") > 1, "mixed").when(F.col("only").isin("deb", "npm"), F.concat("only", F.lit("_only"))).otherwise("other_only")
    return per_id.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("ids"))


def enrichment_effect(phases: DataFrame, before: str, after: str) -> DataFrame:
    """Per image: ids before and after, hidden ids and their share."""
    counts = distinct_counts(phases, ["image_id", "phase"])
    pivoted = counts.groupBy("image_id").agg(
        F.coalesce(F.max(F.when(F.col("phase") == before, F.col("unique_vulns"))), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.when(F.col("phase") == after, F.col("unique_vulns"))), F.lit(0)).alias("after"))
    hidden: Column = F.col("after") - F.col("before")
    return pivoted.select(
        "image_id", "before", "after", hidden.alias("hidden"),
        F.round(stats.percent(hidden, F.col("after")), 1).alias("hidden_pct"), (hidden > 0).alias("affected"))
