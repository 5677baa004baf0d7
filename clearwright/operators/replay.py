"""Verdicts derived again from stored evidence.

A stored statement carries the slice of the catalogue that its verdict rests on, and the alias row if one was used.
Each is resolved against its own slices only, so a changed slice changes no other statement; the binaries'
facts are those found now.  The rules are the ones of `decide`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwright.functions.text import strip_space
from clearwright.operators import decide as D
from clearwright.operators.resolve import resolve_purls
from clearwright.operators.tables import materialize

SLICE = ("component STRING, provenance_status STRING, purls ARRAY<STRUCT<source_file: STRING, position: INT, purl: STRING>>, "
         "identity_symbols ARRAY<STRUCT<symbol: STRING, position: INT>>, identity_strings ARRAY<STRUCT<pattern: STRING, position: BIGINT>>, "
         "cve STRING, vulnerable_symbols ARRAY<STRUCT<name: STRING, confidence: STRING, dynsym_export_verified: BOOLEAN>>")
ALIAS = "source_name STRING, component STRING, status STRING"
_CURATED = ("component", "provenance_status", "purls", "identity_symbols", "identity_strings")


def scoped_slices(stored: DataFrame) -> DataFrame:
    """Distinct (slice, alias row) pairs, parsed; `scope` names the pair, `owner` the component as the slice has it, `entry` the slice."""
    pairs = stored.select("slice", "identity_slice", scope_of().alias("scope")).distinct()
    parsed = pairs.withColumn("s", F.from_json("slice", SLICE)).withColumn("a", F.from_json("identity_slice", ALIAS))
    return parsed.select(
        "scope", F.sha2(F.to_json(F.struct(*(F.col(f"s.{c}") for c in _CURATED))), 256).alias("owner"),
        F.upper(F.sha2("slice", 256)).alias("entry"), "s", "a")


def scope_of():
    return F.sha2(F.concat_ws("\0", "slice", "identity_slice"), 256)


def _catalogue(scopes: DataFrame) -> D.Catalogue:
    """The slices as a catalogue whose components are owners and whose ids are entries."""
    owners = scopes.dropDuplicates(["owner"]).select(F.col("owner").alias("component"), "s")
    entries = scopes.dropDuplicates(["entry"]).select(F.col("owner").alias("component"), F.col("entry").alias("cve"), "s")

    def inlined(rows: DataFrame, keys: list[str], field: str) -> DataFrame:
        return rows.select(*keys, F.inline(f"s.{field}"))

    return D.Catalogue(
        components=owners.select("component", "s.provenance_status"), component_purls=None, aliases=None,
        entries=entries.select("component", "cve"),
        entry_symbols=inlined(entries, ["component", "cve"], "vulnerable_symbols").withColumnRenamed("name", "symbol"),
        identity_symbols=inlined(owners, ["component"], "identity_symbols"),
        identity_strings=inlined(owners, ["component"], "identity_strings"))


def replay(stored: DataFrame, facts: D.BinaryFacts) -> DataFrame:
    """Fresh (artifact_id, cve, component_purl, verdict, justification, rule_id, reason_code, ...) of stored statements.

    `stored` has the statements' keys, `slice` and `identity_slice`, as `statements_from_files` reads them.
    """
    rows = materialize(stored.select("artifact_id", "cve", "component_purl", "slice", "identity_slice", scope_of().alias("scope")).distinct())
    scopes = materialize(scoped_slices(rows))
    purls = scopes.select("scope", F.col("s.component").alias("component"), F.inline("s.purls")).select(
        "scope", "component", "source_file", F.col("position").alias("purl_pos"), F.col("purl").alias("purl_text"))
    aliases = scopes.where(F.col("a.source_name").isNotNull()).select("scope", "a.source_name", "a.component", "a.status")
    resolved = resolve_purls(rows, purls, aliases, "scope").where("valid").drop("valid")

    definitive = F.filter("s.vulnerable_symbols", lambda x: x["confidence"] == "definitive")
    held = scopes.select(
        "scope", "owner", "entry", F.col("s.component").alias("of"), F.upper(strip_space(F.col("s.cve"))).alias("of_cve"),
        F.size(definitive).cast("bigint").alias("n"),
        ((F.size(definitive) > 0) & F.forall(definitive, lambda x: F.coalesce(x["dynsym_export_verified"], F.lit(False)))).alias("exported"))
    joined = rows.select("artifact_id", "cve", "component_purl", "scope").join(resolved, ["scope", "component_purl"]).join(held, "scope")
    found = (F.col("component") == F.col("of")) & (F.upper(strip_space(F.col("cve"))) == F.col("of_cve"))
    facts_of_entry = joined.select(
        "*", F.when(found, F.lit(True)).alias("has_entry"), F.when(found, F.col("n")).alias("n_definitive"), F.when(found, F.col("exported")).alias("all_exported"))
    open_rows = materialize(facts_of_entry.withColumn("early_reason", D.early_refusal()))

    cat = _catalogue(scopes)
    wanted = open_rows.where("has_entry").select("artifact_id", F.col("owner").alias("component"), F.col("entry").alias("cve")).distinct()
    pairs = materialize(wanted)
    carriers = materialize(D.component_inventories(facts, cat, pairs.select("artifact_id", "component").distinct()))
    members = D.identification(carriers).withColumnRenamed("component", "owner")
    own = D.observed_in_component(pairs, carriers, facts.symbols, cat.entry_symbols)
    seen = D.observed_per_entry(pairs, facts.symbols, cat.entry_symbols).join(own, ["artifact_id", "component", "cve"], "left")
    seen = seen.withColumnRenamed("component", "owner").withColumnRenamed("cve", "entry")
    verified = cat.components.select(F.col("component").alias("owner"), (F.coalesce("provenance_status", F.lit("unverified")) == "verified").alias("verified"))
    late = (
        open_rows.join(D.usable_artifacts(facts.inventories), "artifact_id", "left").join(verified, "owner", "left")
        .join(members, ["artifact_id", "owner"], "left").join(seen, ["artifact_id", "owner", "entry"], "left"))
    kept = ("artifact_id", "cve", "component_purl", "purl_type", "quality", "component", "source_name", "alias_status", "has_entry")
    return D.finish(late.select(
        *kept, *[c.alias(k) for k, c in D.verdict_columns().items()], "n_component_inventories", "symbols_observed", "symbols_absent", D.own_symbols()))
