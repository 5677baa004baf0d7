"""Resolve finding PURLs to catalogued components.

All work happens on distinct PURL texts, so a PURL that holds a third of the
findings is parsed and matched once.  Grading is an equi-join on the decoded
name: two PURLs with different names never match.

Where a `scope` column is named, PURLs, catalogue and aliases carry it, and a PURL meets only what is of its own scope:
stored evidence is resolved against its own slices this way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.functions import purl as P
from clearwright.functions.text import blank_to_null, strip_space


def _columns(scope: str | None) -> list[str]:
    return [] if scope is None else [scope]


def parsed_component_purls(component_purls: DataFrame, scope: str | None = None) -> DataFrame:
    """Component PURLs with their parsed form, unusable texts dropped."""
    return (
        P.with_purl(component_purls, "purl_text", "catalogue_purl")
        .where(F.col("catalogue_purl").isNotNull())
        .withColumn("catalogue_name", F.col("catalogue_purl.name"))
        .select(*_columns(scope), "component", "source_file", "purl_pos", "catalogue_name", "catalogue_purl")
    )


def best_component(keyed: DataFrame, key: str, purl: str, catalogue: DataFrame,
                   quality: str = "quality", component: str = "component", scope: str | None = None) -> DataFrame:
    """Best graded match per `key`; ties go to the first file, then the first PURL.

    A best match weaker than name-and-version keeps its quality but no component.
    Other columns of `keyed` depend on the key and are carried along.
    """
    cat = catalogue.withColumnRenamed("component", "__component")
    rank = P.match_quality(F.col(purl), F.col("catalogue_purl"))
    keys = [*_columns(scope), key]
    carried = [c for c in keyed.columns if c not in keys]
    same = F.col("__name") == F.col("catalogue_name")
    if scope is not None:
        cat, same = cat.withColumnRenamed(scope, "__scope"), same & (F.col(scope) == F.col("__scope"))
    graded = (
        keyed.withColumn("__name", F.col(f"{purl}.name"))
        .join(cat, same, "left")
        .select(*keyed.columns, F.coalesce(rank, F.lit(P.NONE)).alias("__rank"),
                "source_file", "purl_pos", "__component")
    )
    first = F.min(F.struct((-F.col("__rank")).alias("negated"), "source_file", "purl_pos", "__component"))
    best = graded.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in carried], first.alias("__best"))
    rank_of = -F.col("__best.negated")
    return best.select(
        *keys, *carried, rank_of.alias(quality),
        F.when(rank_of >= P.NAME_VERSION_ONLY, F.col("__best.__component")).alias(component),
    )


def needs_alias(purl: Column, quality: Column) -> Column:
    """A distro PURL without a direct type-level match goes through the alias table."""
    return P.is_distro(purl) & (quality < P.TYPE_NORMALIZED)


def with_identity(direct: DataFrame, aliases: DataFrame, scope: str | None = None) -> DataFrame:
    """Alias lookup for the rows that need one: refusal, or the upstream PURL text."""
    known = aliases.select(
        *(F.col(c).alias("alias_scope") for c in _columns(scope)),
        strip_space(F.col("source_name")).alias("alias_source"),
        strip_space(F.col("component")).alias("alias_component"),
        F.col("status").alias("alias_status"),
    )
    asked = F.col("__asked")
    same = F.col("source_name") == F.col("alias_source")
    if scope is not None:
        same = same & (F.col(scope) == F.col("alias_scope"))
    staged = (
        P.with_upstream(direct, "purl", "__up")
        .withColumn("__asked", needs_alias(F.col("purl"), F.col("direct_quality")))
        .withColumn("source_name", F.when(asked, F.col("__up.name")))
        .withColumn("__version", F.coalesce(
            blank_to_null(strip_space(F.col("__up.version"))),
            P.upstream_version(F.col("purl.type"), F.col("purl.version"))))
        .join(known, same, "left")
    )
    version = F.col("__version")
    target = F.when(
        F.col("alias_component").contains("@"), F.col("alias_component")
    ).otherwise(F.concat(F.col("alias_component"), F.lit("@"), version))
    mapped = asked & (F.col("alias_status") == "definitive")
    return staged.select(
        *direct.columns, "source_name", "alias_status",
        F.when(mapped, target).alias("mapped_text"),
        F.when(asked & F.col("alias_status").isNull(), "no_identity_mapping")
        .when(asked & (F.col("alias_status") == "probable"), "mapping_probable_only")
        .when(mapped & version.isNull(), "version_underivable")
        .alias("identity_refusal"),
    )


def direct_matches(purls: DataFrame, component_purls: DataFrame) -> DataFrame:
    """Distinct `component_purl` texts, parsed and graded against the catalogue."""
    catalogue = parsed_component_purls(component_purls)
    parsed = P.with_purl(purls.select("component_purl").distinct(), "component_purl")
    return best_component(parsed, "component_purl", "purl", catalogue, "direct_quality", "direct_component")


def resolve_purls(purls: DataFrame, component_purls: DataFrame, aliases: DataFrame, scope: str | None = None) -> DataFrame:
    """One row per distinct PURL text (and scope): quality, component and identity refusal.

    Columns: component_purl, valid, purl_type, direct_quality, source_name,
    alias_status, mapped_text, quality, component, identity_refusal.
    """
    catalogue = parsed_component_purls(component_purls, scope)
    parsed = P.with_purl(purls.select(*_columns(scope), "component_purl").distinct(), "component_purl")
    direct = best_component(parsed, "component_purl", "purl", catalogue, "direct_quality", "direct_component", scope)
    asked = with_identity(direct, aliases, scope)
    second = P.with_purl(asked, "mapped_text", "mapped_purl")
    refusal = F.coalesce(
        F.col("identity_refusal"),
        F.when(F.col("mapped_text").isNotNull() & F.col("mapped_purl").isNull(), "version_underivable"),
    )
    second = second.withColumn("identity_refusal", refusal)
    mapped = best_component(
        second, "component_purl", "mapped_purl", catalogue, "mapped_quality", "mapped_component", scope
    )
    use_mapped = F.col("mapped_purl").isNotNull() & F.col("identity_refusal").isNull()
    quality = F.when(
        use_mapped,
        F.when(F.col("mapped_quality") >= P.TYPE_NORMALIZED, F.lit(P.IDENTITY_MAPPED))
        .otherwise(F.col("mapped_quality")),
    ).otherwise(F.col("direct_quality"))
    return mapped.select(
        *_columns(scope), "component_purl",
        F.col("purl").isNotNull().alias("valid"),
        F.col("purl.type").alias("purl_type"),
        "direct_quality", "source_name", "alias_status", "mapped_text",
        quality.alias("quality"),
        F.when(use_mapped, F.col("mapped_component")).otherwise(F.col("direct_component")).alias("component"),
        "identity_refusal",
    )


def identity_of_purls(purls: DataFrame, aliases: DataFrame) -> DataFrame:
    """(source, status, component) of each distinct PURL: `direct` outside distros, `none` when unmapped."""
    parsed = P.with_purl(purls.select("component_purl").distinct(), "component_purl")
    known = aliases.select(
        F.col("source_name").alias("alias_source"), F.col("component").alias("alias_component"), "status"
    )
    staged = P.with_upstream(parsed).withColumn("upstream_name", F.col("upstream.name"))
    joined = staged.join(known, F.col("upstream_name") == F.col("alias_source"), "left")
    distro, valid = P.is_distro(F.col("purl")), F.col("purl").isNotNull()
    return joined.select(
        "component_purl",
        F.when(valid & ~distro, F.col("purl.name")).when(distro, F.col("upstream_name")).alias("identity_source"),
        F.when(valid & ~distro, "direct").otherwise(F.coalesce("status", F.lit("none"))).alias("identity_status"),
        F.when(valid & ~distro, F.col("purl.name")).otherwise(F.col("alias_component")).alias("identity_component"),
    )
