"""Data-quality rules: each returns violation rows (table, key, rule, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.functions import text as T
from clearwright.functions import verdict as V
from clearwright.operators.factors import compiles

# Enumerations of the curated tables.
CONFIDENCES = ("definitive", "probable")
DERIVATIONS = ("patch-touched-function", "advisory-named", "manual")
EXTRACTION_ALLOWED = ("dpkg-deb-extract", "apk-extract", "rpm2cpio-extract", "pacman-extract")
EXTRACTION_DENIED = (
    "debian-control", "control-file", "changelog", "copyright", "apkbuild", "rpm-spec", "source-tree",
    "container-layer", "oci-export", "docker-save", "grype-upstream", "upstream-qualifier", "sbom-assertion",
    "third-party", "automated-scrape",
)
ARTIFACT_CLASSES = ("firmware", "oci-app", "oci-base", "static-binary", "substitute-container", "benchmark")
ARTIFACT_STATUSES = ("present", "absent")
MIN_ARTIFACTS = 40
MIN_FIRMWARE = 10


def violations(df: DataFrame, table: str, key: Column, rules: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """Rows that break a rule, one per broken rule; a rule column is true when it is broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    told = F.lit(None).cast("string") if detail is None else detail
    return df.select(
        F.lit(table).alias("table"), key.cast("string").alias("key"), F.explode(broken).alias("rule"), told.alias("detail"))


def _empty(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _some_blank(c: str) -> Column:
    return F.coalesce(F.exists(c, T.is_blank), F.lit(False))


def manifest_components(components: DataFrame) -> DataFrame:
    """Required component fields and non-empty lists."""
    return violations(components, "components", F.col("name"), {
        "name_required": T.is_blank(F.col("name")), "ecosystem_required": T.is_blank(F.col("ecosystem")),
        "purls_required": _empty("purls") | _some_blank("purls"),
        "identity_symbols_required": _empty("identity_symbols") | _some_blank("identity_symbols"),
        "identity_strings_blank": _some_blank("identity_strings"),
    })


def manifest_entries(entries: DataFrame) -> DataFrame:
    """Entry rules: id shape, versions, symbols and their provenance."""
    s = "vulnerable_symbols"

    def some(test) -> Column:
        return F.coalesce(F.exists(s, test), F.lit(False))

    return violations(entries, "entries", F.concat_ws("/", "component", "cve"), {
        "cve_shape": ~T.is_cve(F.col("cve")),
        "affected_versions_required": _empty("affected_versions") | _some_blank("affected_versions"),
        "manifest_version_required": T.is_blank(F.col("manifest_version")),
        "symbols_required": _empty(s),
        "symbol_name_required": some(lambda x: T.is_blank(x["name"])),
        "confidence_enum": some(lambda x: ~F.coalesce(x["confidence"].isin(*CONFIDENCES), F.lit(False))),
        "fix_url": some(lambda x: ~T.is_http_url(x["provenance"]["upstream_fix_commit"])),
        "derivation_enum": some(lambda x: ~F.coalesce(x["provenance"]["derivation"].isin(*DERIVATIONS), F.lit(False))),
        "reviewer_required": some(lambda x: T.is_blank(x["provenance"]["reviewed_by"])),
        "review_date": some(lambda x: ~T.is_real_date(x["provenance"]["reviewed_at"])),
    })


def identity_patterns(identity_strings: DataFrame) -> DataFrame:
    """Identity regexes that the engine matching them does not accept, each judged once, where its row is."""
    bad = identity_strings.select("pattern").distinct().where(~compiles(F.col("pattern")))
    return identity_strings.select("component", "pattern").distinct().join(bad, "pattern").select(
        F.lit("identity_strings").alias("table"), F.col("component").alias("key"), F.lit("pattern_compiles").alias("rule"),
        F.col("pattern").alias("detail"))


def aliases(aliases_: DataFrame) -> DataFrame:
    """Alias rules; a definitive alias needs its whole provenance and an accepted extraction method."""
    definitive = F.col("status") == "definitive"
    p = "provenance."

    def need(c: str) -> Column:
        return definitive & T.is_blank(F.col(p + c))

    method = T.strip_space(F.col(p + "extraction_method"))
    rules = {
        "source_name_required": T.is_blank(F.col("source_name")), "component_required": T.is_blank(F.col("component")),
        "status_enum": ~F.coalesce(F.col("status").isin(*CONFIDENCES), F.lit(False)),
        "artifact_sha256": definitive & ~T.is_sha256(F.col(p + "artifact_sha256")),
        "distro_required": need("distro"), "package_name_required": need("package_name"),
        "package_version_required": need("package_version"),
        "verified_at": definitive & ~T.is_date_shape(T.strip_space(F.col(p + "verified_at"))),
        "binary_path_required": need("binary_path"),
        "identity_symbols_verified": definitive & (_empty(p + "identity_symbols_verified") | _some_blank(p + "identity_symbols_verified")),
        "reviewed_by_required": need("reviewed_by"), "extraction_method_required": need("extraction_method"),
        "extraction_method_denied": definitive & F.coalesce(method.isin(*EXTRACTION_DENIED), F.lit(False)),
        "extraction_method_allowed": definitive & ~T.is_blank(method)
        & ~F.coalesce(method.isin(*EXTRACTION_ALLOWED, *EXTRACTION_DENIED), F.lit(False)),
    }
    return violations(aliases_, "aliases", F.col("source_name"), rules).unionByName(
        duplicates(aliases_.select(T.strip_space(F.col("source_name")).alias("k")), "aliases", "k", "source_name_unique"))


def duplicates(df: DataFrame, table: str, key: str, rule: str) -> DataFrame:
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.select(
        F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"),
        F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))


def catalogue(artifacts: DataFrame) -> DataFrame:
    """Artifact catalogue: unique ids, enums, a hash exactly when present, a source URL, minimum counts."""
    present, hashed = F.col("status") == "present", ~T.is_blank(F.col("sha256"))
    rows = violations(artifacts, "artifacts", F.col("artifact_id"), {
        "class_enum": ~F.coalesce(F.col("class").isin(*ARTIFACT_CLASSES), F.lit(False)),
        "status_enum": ~F.coalesce(F.col("status").isin(*ARTIFACT_STATUSES), F.lit(False)),
        "hash_iff_present": present != hashed, "hash_shape": hashed & ~T.is_sha256(F.col("sha256")),
        "source_url_required": ~T.is_http_url(F.col("source_url")),
    })
    totals = artifacts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == "firmware").alias("f"))
    few = violations(totals, "artifacts", F.lit("*"), {
        "min_artifacts": F.col("n") < MIN_ARTIFACTS, "min_firmware": F.col("f") < MIN_FIRMWARE})
    return rows.unionByName(duplicates(artifacts, "artifacts", "artifact_id", "id_unique")).unionByName(few)


def emit_inputs(documents: DataFrame) -> DataFrame:
    """VEX emission needs bundle id, artifact hash, RFC 3339 time and identified statements."""
    return violations(documents, "emit_inputs", F.col("artifact_id"), {
        "bundle_id_required": T.is_blank(F.col("bundle_id")), "artifact_sha256_required": T.is_blank(F.col("artifact_sha256")),
        "timestamp_rfc3339": ~T.is_rfc3339(F.col("timestamp")), "cve_required": T.is_blank(F.col("cve")),
        "component_purl_required": T.is_blank(F.col("component_purl")),
    })


def promotion(candidates: DataFrame) -> DataFrame:
    """Candidates that may not be promoted."""
    s = "vulnerable_symbols"
    return violations(candidates, "candidates", F.concat_ws("/", "component", "cve"), {
        "reviewed_by_required": T.is_blank(F.col("reviewed_by")), "reviewed_at_date": ~T.is_real_date(F.col("reviewed_at")),
        "already_published": F.coalesce(F.col("source_file").contains("components/"), F.lit(False)),
        "component_required": T.is_blank(F.col("component")) | T.is_blank(F.col("ecosystem")),
        "symbols_required": _empty(s),
        "symbol_name_required": F.coalesce(F.exists(s, lambda x: T.is_blank(x["name"])), F.lit(False)),
        "fix_url_required": F.coalesce(F.exists(s, lambda x: T.is_blank(x["provenance"]["upstream_fix_commit"])), F.lit(False)),
        "manifest_version_required": T.is_blank(F.col("manifest_version")),
    })


def promote(candidates: DataFrame) -> DataFrame:
    """Accepted candidates with every symbol definitive and the reviewer recorded."""
    bad = promotion(candidates).select("key").distinct()
    keyed = candidates.withColumn("key", F.concat_ws("/", "component", "cve"))

    def lifted(x: Column) -> Column:
        p = x["provenance"]
        p = p.withField("reviewed_by", F.col("reviewed_by")).withField("reviewed_at", F.col("reviewed_at"))
        p = p.withField("derivation", F.coalesce(T.blank_to_null(x["provenance"]["derivation"]), F.lit(DERIVATIONS[0])))
        return x.withField("confidence", F.lit("definitive")).withField("provenance", p)

    return keyed.join(bad, "key", "left_anti").drop("key").withColumn(
        "vulnerable_symbols", F.transform("vulnerable_symbols", lifted))


def forced_probable(symbols: Column) -> Column:
    """Candidate symbols are always probable and carry no review."""
    none = F.lit(None).cast("string")

    def lowered(x: Column) -> Column:
        p = x["provenance"].withField("reviewed_by", none).withField("reviewed_at", none)
        return x.withField("confidence", F.lit("probable")).withField("provenance", p)

    return F.transform(symbols, lowered)


def proposals(rows: DataFrame) -> DataFrame:
    return violations(rows, "proposals", F.concat_ws("/", "component", "cve"), {
        "component_required": T.is_blank(F.col("component")), "cve_shape": ~T.is_cve(F.upper(T.strip_space(F.col("cve")))),
        "fix_commit_url": ~F.coalesce(F.col("fix_commit").startswith("http"), F.lit(False)),
        "affected_versions_required": _empty("affected_versions"), "verification_required": T.is_blank(F.col("verification")),
        "fixture_or_recipe": T.is_blank(F.col("fixture")) & T.is_blank(F.col("build_recipe")),
    })


def proposals_without_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Proposals whose component does not exist yet."""
    lost = rows.join(components.select(F.col("name").alias("component")).distinct(), "component", "left_anti")
    return violations(lost, "proposals", F.concat_ws("/", "component", "cve"), {"component_exists": F.lit(True)})


def _derive_rules() -> dict[str, Column]:
    return {
        "component_required": T.is_blank(F.col("component")), "ecosystem_required": T.is_blank(F.col("ecosystem")),
        "repo_required": T.is_blank(F.col("repo")), "purls_required": _empty("purls"),
        "identity_symbols_required": _empty("identity_symbols"), "cve_required": T.is_blank(F.col("cve")),
        "fix_commit_required": T.is_blank(F.col("fix_commit")), "affected_versions_required": _empty("affected_versions"),
    }


def derive_inputs(rows: DataFrame) -> DataFrame:
    """Derive-job rows: component fields and one row per CVE fix."""
    return violations(rows, "derive_inputs", F.concat_ws("/", "component", "cve"), _derive_rules())


def valid_derive_inputs(rows: DataFrame) -> DataFrame:
    """Derive-job rows that break none of the rules."""
    broken = [F.coalesce(c, F.lit(True)) for c in _derive_rules().values()]
    return rows.where(~F.greatest(*(b.cast("int") for b in broken)).cast("boolean"))


def candidates(rows: DataFrame) -> DataFrame:
    """Candidate entries: probable only, unreviewed, every symbol with an https fix."""
    s = "vulnerable_symbols"

    def some(test) -> Column:
        return F.coalesce(F.exists(s, test), F.lit(False))

    return violations(rows, "candidates", F.concat_ws("/", "component", "cve"), {
        "no_definitive": some(lambda x: x["confidence"] == "definitive"),
        "no_reviewer": some(lambda x: ~T.is_blank(x["provenance"]["reviewed_by"]) | ~T.is_blank(x["provenance"]["reviewed_at"])),
        "https_fix_url": some(lambda x: ~F.coalesce(x["provenance"]["upstream_fix_commit"].startswith("https://"), F.lit(False))),
        "some_probable": ~some(lambda x: x["confidence"] == "probable"),
    })


def decisions(rows: DataFrame) -> DataFrame:
    """Verdict invariants: what each verdict must and must not carry."""
    v = F.col("verdict")
    no_reason, no_just = T.is_blank(F.col("reason_code")), T.is_blank(F.col("justification"))
    return violations(rows, "decisions", F.concat_ws("|", "artifact_id", "cve", "component_purl"), {
        "verdict_enum": ~F.coalesce(v.isin(V.NOT_AFFECTED, V.AFFECTED, V.UNDER_INVESTIGATION), F.lit(False)),
        "cleared_has_justification": (v == V.NOT_AFFECTED) & no_just,
        "refusal_has_reason": (v == V.UNDER_INVESTIGATION) & no_reason,
        "affected_has_neither": (v == V.AFFECTED) & (~no_reason | ~no_just),
        "forbidden_justification": F.coalesce(F.col("justification").isin(*V.FORBIDDEN_JUSTIFICATIONS), F.lit(False)),
    })


def manifest_coverage(entries: DataFrame, suffix: str = "") -> DataFrame:
    """CVEs per component by confidence class; candidates get a name suffix."""
    kind = V.confidence_class(F.col("vulnerable_symbols"))
    return entries.groupBy(F.col("ecosystem"), F.concat("component", F.lit(suffix)).alias("component")).agg(
        F.count_if(kind == "definitive").alias("definitive"), F.count_if(kind == "probable").alias("probable"),
        F.count_if(kind == "none").alias("none"))
