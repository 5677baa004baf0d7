"""Evidence tables, bundle digests, verification and the evidence pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.functions import purl as P
from clearwright.functions import verdict as V
from clearwright.functions.text import blank_to_null, strip_space
from clearwright.operators.digests import LINE_FORMATS, content_digest
from clearwright.operators.factors import BROADCAST_ROWS, joined
from clearwright.operators.tables import materialize, stored

FORMAT_VERSION = "evidence-v1"

# Statement fields in file order.
STATEMENT = ("cve", "component_purl", "verdict", "justification", "rule_id", "reason_code")


def artifact_digests(inventories: DataFrame) -> DataFrame:
    """Artifact hash over its (path, sha256) lines."""
    line = LINE_FORMATS["artifact"](F.col("path"), F.col("sha256"))
    return content_digest(inventories, ["artifact_id"], line, "artifact_sha256")


def slices(wanted: DataFrame, components: DataFrame, entry_symbols: DataFrame, component_purls: DataFrame,
           identity_symbols: DataFrame, identity_strings: DataFrame, version: str) -> DataFrame:
    """Catalogue slice per wanted (component, cve), as JSON: all that a verdict on it rests on.

    That is the component with its PURLs and identity rules, and the entry with its symbols.
    Pairs without an entry are left out; that is a normal outcome.
    """
    asked = wanted.select("component").distinct()

    def listed(rows: DataFrame, keys: list[str], out: str, **fields: str) -> DataFrame:
        item = F.struct(*(F.col(c).alias(name) for name, c in fields.items()))
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias(out))

    # Entries are cut down to the wanted ones before their symbols are listed.
    of_wanted = entry_symbols.join(wanted.select("component", "cve").distinct(), ["component", "cve"], "left_semi")
    per_entry = listed(of_wanted, ["component", "cve"], "vulnerable_symbols", name="symbol", confidence="confidence", dynsym_export_verified="dynsym_export_verified")
    about = components.select("component", "provenance_status").join(asked, "component", "left_semi")
    for rows, out, fields in (
        (component_purls, "purls", {"source_file": "source_file", "position": "purl_pos", "purl": "purl_text"}),
        (identity_symbols, "identity_symbols", {"symbol": "symbol", "position": "position"}),
        (identity_strings, "identity_strings", {"pattern": "pattern", "position": "position"}),
    ):
        about = about.join(listed(rows.join(asked, "component", "left_semi"), ["component"], out, **fields), "component", "left")
    # What is of the component is written once per component; a slice adds its entry.  Version and cve are never null, so neither part is empty.
    head = F.to_json(F.struct(F.lit(version).alias("version"), F.col("component"), "provenance_status", "purls", "identity_symbols", "identity_strings"))
    heads = materialize(about.select("component", head.alias("head")).withColumn("head", F.substring("head", F.lit(1), F.length("head") - 1)))
    entry = F.to_json(F.struct("cve", "vulnerable_symbols"))
    body = F.concat("head", F.lit(","), F.substring(entry, 2, F.length(entry)))
    known = joined(wanted.join(per_entry, ["component", "cve"]), heads, heads.count(), "component")
    return known.select("component", "cve", body.alias("slice")).select("component", "cve", "slice", F.sha2("slice", 256).alias("slice_sha256"))


def identity_slices(aliases: DataFrame) -> DataFrame:
    """Alias rows as JSON, for the statements that were resolved through one."""
    return aliases.select("source_name", F.to_json(F.struct("source_name", "component", "status")).alias("identity_slice"))


def evidence_statements(decisions: DataFrame) -> DataFrame:
    """Decisions that carry evidence, keyed by (artifact, cve, purl); `statement_id` is a label."""
    return decisions.where("has_slice").select(
        "artifact_id", "statement_id", *STATEMENT, "component", "source_name", "symbols_observed", "symbols_absent")


def observed_symbols(statements: DataFrame, symbols: DataFrame) -> DataFrame:
    """Long table behind a statement: its observed symbols per inventory that shows them.

    Statements of an artifact name the same few symbols again and again, so the binaries' symbols are cut down to the named
    ones first, and only these meet the statements; a short list of them comes to the statements, which are many more.
    """
    seen = statements.select("artifact_id", "cve", "component_purl", F.explode("symbols_observed").alias("symbol"))
    key = F.coalesce(blank_to_null(F.col("normalized")), F.col("raw"))
    named = materialize(seen.select("artifact_id", "symbol").distinct())
    shown = symbols.select("artifact_id", "inventory_id", "raw", "defined", "table_kind", key.alias("symbol"))
    shown = stored(joined(shown, named, named.count(), ["artifact_id", "symbol"], "left_semi"))
    met = joined(seen, shown, shown.count(), ["artifact_id", "symbol"])
    return met.select("artifact_id", "symbol", "inventory_id", "raw", "defined", "table_kind", "cve", "component_purl")


def observations(statements: DataFrame, symbols: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long tables behind a statement: symbols seen per inventory, and identity hits per inventory."""
    named = statements.select("artifact_id", "component").distinct()
    hits = members.select("artifact_id", "component", "inventory_id", "kind", "reason").join(
        named, ["artifact_id", "component"], "left_semi")
    return observed_symbols(statements, symbols), hits


def statement_files(statements: DataFrame, slice_rows: DataFrame, identities: DataFrame, artifact_hashes: DataFrame, version: str) -> DataFrame:
    """One row per evidence file: artifact, file path, body and its SHA-256.

    Artifacts are few, and most statements have no source name: the slices they carry would be shuffled to a few tasks, so short lists of both
    come to the statements.
    """
    folder = F.concat_ws("/", F.lit("statements"), F.col("statement_id"), F.sha2("component_purl", 256))
    identities, artifact_hashes = stored(identities), stored(artifact_hashes)
    rows = statements.join(slice_rows, ["component", "cve"], "left")
    rows = joined(rows, identities, identities.count(), "source_name", "left")
    rows = joined(rows, artifact_hashes, artifact_hashes.count(), "artifact_id", "left")
    files = F.array(
        _file("statement.json", F.to_json(F.struct(*STATEMENT))),
        _file("inputs.json", F.to_json(F.struct("artifact_sha256"))),
        _file("observations.json", F.to_json(F.struct("symbols_observed", "symbols_absent"))),
        _file("manifest-slice.json", F.coalesce("slice", F.lit("{}")), F.col("slice_sha256")),
        _file("identity-slice.json", F.coalesce("identity_slice", F.lit("{}"))),
        _file("versions.json", F.to_json(F.struct(F.lit(version).alias("manifest_version"), F.lit(FORMAT_VERSION).alias("spec_version")))),
    )
    rows = rows.select("artifact_id", folder.alias("folder"), F.inline(files))
    return rows.select(
        "artifact_id", F.concat_ws("/", "folder", "name").alias("path"), "body", F.coalesce("known", F.sha2("body", 256)).alias("sha256"))


def _file(name: str, body: Column, known: Column | None = None) -> Column:
    """A file of a statement; `known` is the body's SHA-256 where many statements share it."""
    return F.struct(F.lit(name).alias("name"), body.alias("body"), (F.lit(None).cast("string") if known is None else known).alias("known"))


def bundle_ids(files: DataFrame) -> DataFrame:
    """Bundle id per artifact over its checksum lines."""
    return content_digest(files, ["artifact_id"], LINE_FORMATS["bundle"](F.col("path"), F.col("sha256")), "bundle_id")


# ------------------------------------------------------------- verification

def loose_purl(text: Column) -> Column:
    return P.without_checksum_query(strip_space(text))


def status_agrees(verdict: Column, justification: Column, status: Column, vex_justification: Column) -> Column:
    """A VEX status that says the same as the verdict; justifications must agree when both are given."""
    j, w = blank_to_null(F.lower(justification)), blank_to_null(F.lower(vex_justification))
    return (
        F.when(F.upper(verdict) == V.NOT_AFFECTED, (status == "not_affected") & F.coalesce(j == w, F.lit(True)))
        .when(F.upper(verdict) == V.AFFECTED, status == "affected")
        .when(F.upper(verdict) == V.UNDER_INVESTIGATION, status == "under_investigation")
        .otherwise(F.lit(False))
    )


def in_vex(statements: DataFrame, vex: DataFrame) -> DataFrame:
    """Statements that some VEX row repeats: same id, same PURL up to its checksum, agreeing status.

    PURLs are most of the bytes and few differ, so both sides carry a number for them to where they meet, as long as the list of PURLs
    is short enough for a broadcast.  Ids and PURLs begin alike, so longer lists are sorted by a hash of the two first.
    """
    rows = vex.select(
        F.upper("vulnerability").alias("__cve"), F.col("product_purl"), loose_purl(F.col("product_purl")).alias("__purl"),
        F.col("status").alias("__status"), F.col("justification").alias("__just"))
    cve, purl = F.upper("cve"), loose_purl(F.col("component_purl"))
    agrees = status_agrees(F.col("verdict"), F.col("justification"), F.col("__status"), F.col("__just"))
    texts = stored(vex.select(F.col("product_purl").alias("__text")).distinct())
    if texts.count() <= BROADCAST_ROWS:
        loose = texts.select("__text", loose_purl(F.col("__text")).alias("__purl")).where("__purl IS NOT NULL")
        numbers = stored(loose.select("__purl").distinct().withColumn("__number", F.monotonically_increasing_id()))
        of_text = stored(loose.join(numbers, "__purl").select(F.col("__text").alias("product_purl"), "__number"))
        there = rows.drop("__purl").join(F.broadcast(of_text), "product_purl").drop("product_purl")
        own = statements.withColumn("__purl", purl).join(F.broadcast(numbers.withColumnRenamed("__number", "__own")), "__purl").drop("__purl")
        return own.join(there, (F.col("__own") == F.col("__number")) & (cve == F.col("__cve")) & agrees, "left_semi").drop("__own").select(*statements.columns)
    rows = rows.drop("product_purl").withColumn("__hash", F.xxhash64("__cve", "__purl"))
    keyed = statements.withColumn("__own", F.xxhash64(cve, purl))
    same = (F.col("__own") == F.col("__hash")) & (cve == F.col("__cve")) & (purl == F.col("__purl")) & agrees
    return keyed.join(rows, same, "left_semi").drop("__own")


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """(artifact_id, folder) of statements whose files differ between two states of the evidence, by their folders' digests."""
    folder = F.regexp_replace("path", r"/[^/]+$", "")

    def digests(files: DataFrame, out: str) -> DataFrame:
        rows = files.withColumn("folder", folder)
        return content_digest(rows, ["artifact_id", "folder"], LINE_FORMATS["bundle"](F.col("path"), F.col("sha256")), out)

    both = digests(before, "__before").join(digests(after, "__after"), ["artifact_id", "folder"], "full")
    return both.where(~F.col("__before").eqNullSafe(F.col("__after"))).select("artifact_id", "folder")


def hash_checks(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per artifact: do all expected files exist with the expected hash?"""
    found = actual.select("artifact_id", "path", F.col("sha256").alias("__actual"))
    same = F.coalesce(F.col("sha256") == F.col("__actual"), F.lit(False))
    return expected.join(found, ["artifact_id", "path"], "left").groupBy("artifact_id").agg(
        F.bool_and(same).alias("hashes_ok"), F.count_if(~same).alias("bad_files"))


def verify(stored: DataFrame, fresh: DataFrame, checks: DataFrame, vex: DataFrame | None = None) -> DataFrame:
    """Stored statements against freshly derived ones: VERIFIED, MISMATCH or UNVERIFIABLE."""
    key = ["artifact_id", "cve", "component_purl"]
    again = fresh.select(*key, *[F.col(c).alias(f"__{c}") for c in ("verdict", "justification", "rule_id", "reason_code")])
    joined = stored.join(again, key, "left").join(checks.select("artifact_id", "hashes_ok"), "artifact_id", "left")

    def kept(c: str) -> Column:
        return blank_to_null(F.col(c)).isNull() | F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))

    equal = (
        (F.upper("verdict") == F.col("__verdict")) & kept("justification") & (F.col("rule_id") == F.col("__rule_id"))
        & kept("reason_code")
        & ~(blank_to_null(F.col("reason_code")).isNull() & F.col("__reason_code").isNotNull()
            & (F.col("__verdict") == V.UNDER_INVESTIGATION))
    )
    listed = F.lit(True)
    if vex is not None:
        repeated = in_vex(stored, vex).select(*key, F.lit(True).alias("__listed")).distinct()
        joined, listed = joined.join(repeated, key, "left"), F.coalesce("__listed", F.lit(False))
    status = (
        F.when(~F.coalesce("hashes_ok", F.lit(False)) | F.col("__verdict").isNull(), "UNVERIFIABLE")
        .when(F.coalesce(equal, F.lit(False)) & listed, "VERIFIED").otherwise("MISMATCH")
    )
    return joined.select(*key, status.alias("verification"))


def all_verified(verified: DataFrame) -> DataFrame:
    return verified.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("statements"), F.bool_and(F.col("verification") == "VERIFIED").alias("all_verified"))


def find_statements(statements: DataFrame, lookups: DataFrame) -> DataFrame:
    """Lookups (artifact_id, cve, optional purl) with their outcome: found, none or ambiguous.

    A lookup with a PURL is exact on three keys; one without asks for the count and the least PURL of its
    (artifact, cve).  Both sides of the statements are aggregated first, so a join gives a row per lookup.
    """
    exact = statements.groupBy("artifact_id", "cve", "component_purl").agg(F.count(F.lit(1)).alias("n"))
    any_purl = exact.groupBy("artifact_id", "cve").agg(F.sum("n").alias("n"), F.min("component_purl").alias("component_purl"))
    named = lookups.where("wanted_purl IS NOT NULL").join(
        exact.withColumnRenamed("component_purl", "wanted_purl"), ["artifact_id", "cve", "wanted_purl"], "left").withColumn(
        "component_purl", F.when(F.col("n").isNotNull(), F.col("wanted_purl")))
    open_ = lookups.where("wanted_purl IS NULL").join(any_purl, ["artifact_id", "cve"], "left")
    columns = ["artifact_id", "cve", "wanted_purl", "component_purl", F.coalesce("n", F.lit(0)).alias("matches")]
    n = F.col("matches")
    return named.select(*columns).unionByName(open_.select(*columns)).select(
        "artifact_id", "cve", "wanted_purl", "matches", F.when(n > 0, F.col("component_purl")).alias("component_purl"),
        F.when(n == 0, "none").when((n > 1) & F.col("wanted_purl").isNull(), "ambiguous").otherwise("found").alias("outcome"))


# --------------------------------------------------------------------- pack

def evidence_pack(decisions: DataFrame, components: DataFrame, identity: DataFrame) -> DataFrame:
    """One row per decision with everything a reader needs to follow it.

    Components and the identities of distinct PURLs are counted, so that short lists come to the decisions and these are not shuffled.
    """
    known = stored(components.select("component", F.col("provenance_status").alias("provenance")))
    of_purl = stored(identity)
    rows = joined(decisions, known, known.count(), "component", "left")
    rows = joined(rows, of_purl, of_purl.count(), "component_purl", "left")
    absent, present = F.array_join("symbols_absent", ","), F.array_join("symbols_observed", ",")
    rows = rows.select(
        "artifact_id", "cve", "component_purl", "verdict", "rule_id", "reason_code", "justification", "component",
        F.when(F.col("has_slice"), F.col("provenance")).alias("provenance"), "identity_source", "identity_status",
        "identity_component", absent.alias("symbols_absent"), present.alias("symbols_present"),
        (F.coalesce("n_component_inventories", F.lit(0)) > 0).alias("component_identified"), "has_slice", "statement_id",
        V.evidence_kind(F.col("justification"), F.size("symbols_absent")).alias("evidence_kind"))
    return rows.withColumn("detail", row_detail())


def row_detail() -> Column:
    """One line of detail per verdict; empty parts vanish."""
    def part(label: str, c: str) -> Column:
        return F.concat(F.lit(f"{label}="), blank_to_null(F.col(c)))

    mapping = F.concat(
        F.lit("identity="), F.col("identity_status"), F.lit(" ("), F.coalesce("identity_source", F.lit("")), F.lit(" to "),
        F.coalesce("identity_component", F.lit("")), F.lit(")"))
    cleared = F.concat_ws(
        "; ", part("justification", "justification"), part("evidence", "evidence_kind"),
        F.when(F.col("has_slice"), part("manifest", "component")), part("provenance", "provenance"), mapping,
        part("symbols_absent", "symbols_absent"),
        F.when((F.col("evidence_kind") == V.COMPONENT_ABSENT) | ~F.col("component_identified"), "component_identified=false"),
        F.when(F.col("has_slice"), part("bundle", "statement_id")))
    return (
        F.when(F.col("verdict") == V.NOT_AFFECTED, cleared)
        .when(F.col("verdict") == V.UNDER_INVESTIGATION, part("refusal", "reason_code"))
        .otherwise(F.coalesce(part("symbols_present", "symbols_present"), F.lit("affected")))
    )


def explanations(pack: DataFrame) -> DataFrame:
    """Plain-language projection of the pack."""
    return pack.select(
        "artifact_id", "cve", "component_purl",
        V.verdict_words(F.col("verdict"), F.col("justification")).alias("verdict_text"),
        V.rule_words(F.col("rule_id"), F.col("reason_code")).alias("rule_text"),
        V.closing_words(F.col("verdict")).alias("closing_text"), "symbols_present", "symbols_absent", "provenance")


# ---------------------------------------------------------------- integrity

def integrity(catalogue: DataFrame, actual: DataFrame) -> DataFrame:
    """Catalogue rows against what is on disk (artifact_id, actual_sha256)."""
    on_disk = actual.select("artifact_id", F.col("actual_sha256"), F.lit(True).alias("__present"))
    outcome = V.integrity_outcome(F.col("sha256"), F.col("__present"), F.col("actual_sha256"))
    return catalogue.join(on_disk, "artifact_id", "left").select("artifact_id", "class", outcome.alias("outcome"))


def integrity_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("artifacts"), F.bool_and(F.col("outcome") == "ok").alias("success"))


def work_list(catalogue: DataFrame) -> DataFrame:
    """How each catalogue row is to be scanned: skipped, local, or by ref, url or path."""
    mode = (
        F.when(blank_to_null(F.col("sha256")).isNull(), "skip").when(F.col("class") == "benchmark", "local")
        .when(blank_to_null(F.col("ref")).isNotNull(), "ref").when(blank_to_null(F.col("url")).isNotNull(), "url")
        .otherwise("path")
    )
    return catalogue.select("artifact_id", mode.alias("mode"))
