"""Decide findings: refused, affected or not affected, with the rule and reason.

Findings without a reviewed entry are refused first, on resolution alone; only the
rest meets the symbol side, whose facts are computed once per artifact.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.functions import purl as P
from clearwright.functions import symbols as S
from clearwright.functions import verdict as V
from clearwright.functions import version_order as O
from clearwright.functions.text import blank_to_null, statement_id, strip_space
from clearwright.operators import factors
from clearwright.operators.resolve import resolve_purls
from clearwright.operators.tables import materialize, scratch, stored


@dataclass(frozen=True)
class Catalogue:
    """Curated side: what is known about components, entries and their symbols."""

    components: DataFrame  # component, provenance_status, ...
    component_purls: DataFrame  # component, source_file, purl_pos, purl_text
    entries: DataFrame  # component, cve
    entry_symbols: DataFrame  # component, cve, symbol, confidence, dynsym_export_verified
    aliases: DataFrame  # source_name, component, status
    identity_symbols: DataFrame  # component, symbol, position
    identity_strings: DataFrame  # component, position, pattern


@dataclass(frozen=True)
class BinaryFacts:
    """Observed side, keyed by artifact and inventory."""

    inventories: DataFrame  # artifact_id, inventory_id, format, stripped, static_linked, has_dynamic, has_table
    symbols: DataFrame  # artifact_id, inventory_id, raw, normalized
    ro_strings: DataFrame  # artifact_id, inventory_id, value


def normalize_findings(raw: DataFrame) -> DataFrame:
    """Upper-case ids, trim, drop empties, keep distinct (artifact, cve, purl)."""
    return (
        raw.select(
            "artifact_id",
            F.upper(strip_space(F.col("cve"))).alias("cve"),
            strip_space(F.col("component_purl")).alias("component_purl"),
        )
        .where((F.col("cve") != "") & (F.col("component_purl") != ""))
        .distinct()
    )


def entry_facts(entries: DataFrame, entry_symbols: DataFrame) -> DataFrame:
    """Per (component, cve): number of definitive symbols and whether all were seen exported."""
    definitive = F.col("confidence") == "definitive"
    # Symbols are many to an entry: ids are put in order once per text of an id, not once per symbol.
    written = entry_symbols.groupBy("component", "cve").agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.count_if(definitive).alias("n_definitive"),
        F.bool_and(F.when(definitive, F.coalesce("dynsym_export_verified", F.lit(False)))).alias("exported"),
    )
    counted = written.groupBy("component", F.upper(strip_space(F.col("cve"))).alias("cve")).agg(
        F.sum("n_symbols").alias("n_symbols"), F.sum("n_definitive").alias("n_definitive"),
        F.coalesce(F.bool_and("exported"), F.lit(False)).alias("all_exported"))
    keys = entries.select("component", F.upper(strip_space(F.col("cve"))).alias("cve")).distinct()
    return keys.join(counted, ["component", "cve"], "left").select(
        "component", "cve", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"),
        F.coalesce("n_definitive", F.lit(0)).alias("n_definitive"),
        F.coalesce("all_exported", F.lit(False)).alias("all_exported"), F.lit(True).alias("has_entry"),
    )


def early_refusal() -> Column:
    """The refusals that need no binary facts, in order."""
    return (
        F.when(F.col("identity_refusal").isNotNull(), F.col("identity_refusal"))
        .when((F.col("quality") <= P.NAME_ONLY) | F.col("component").isNull(), "purl_match_insufficient")
        .when(F.col("has_entry").isNull(), "manifest_no_entry")
        .when(F.col("n_definitive") == 0, "manifest_probable_only")
    )


def outside_affected_versions(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """(component, cve, component_purl) of findings whose version lies in none of the entry's affected ranges.

    `findings` has (component, cve, component_purl), `ranges` (component, cve, ecosystem, introduced, fixed) with open ends null.  Keys are
    made once per distinct PURL and per range; the join is on component, id and ecosystem, and the range is a condition on
    the few ranges of an entry.  An entry without a range for the ecosystem, or a version without an order, excludes nothing.
    """
    parsed = P.with_purl(findings.select("component_purl").distinct(), "component_purl")
    keyed = parsed.select("component_purl", F.col("purl.type").alias("ecosystem"), O.version_key(F.col("purl.type"), F.col("purl.version")).alias("key")).where("key IS NOT NULL")
    ends = {c: O.version_key(F.col("ecosystem"), F.col(c)).alias(c) for c in ("introduced", "fixed")}
    bounds = ranges.select("component", F.upper(strip_space(F.col("cve"))).alias("cve"), "ecosystem", *ends.values())
    asked = findings.select("component", "cve", "component_purl").distinct().join(keyed, "component_purl")
    inside = O.in_range(F.col("key"), F.col("introduced"), F.col("fixed"))
    return asked.join(bounds, ["component", "cve", "ecosystem"]).groupBy("component", "cve", "component_purl").agg(
        F.bool_or(inside).alias("inside")).where("NOT inside").drop("inside")


def hashed_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on texts that begin alike, such as PURLs: where it sorts, it sorts by a hash of them first."""
    key = F.xxhash64(*on)
    return left.withColumn("__hash", key).join(right.withColumn("__hash", key), ["__hash", *on], how).drop("__hash")


def marked_findings(findings: DataFrame, cat: Catalogue) -> tuple[DataFrame, DataFrame, int]:
    """Findings as (artifact_id, cve, component, purl_number, has_entry), the numbered resolution of PURLs, and its count; both stored.

    PURL texts are most of a finding's bytes and few of them differ, so only their numbers are shuffled to the entries, and only
    for findings with a component; up to a bound the resolution itself is broadcast.  The texts of findings are stored until then.
    """
    with scratch(findings.sparkSession):
        rows = stored(findings.select("artifact_id", "cve", "component_purl"))
        resolution = stored(
            resolve_purls(rows, cat.component_purls, cat.aliases).where("valid").drop("valid", "mapped_text")
            .withColumn("purl_number", F.monotonically_increasing_id()), beyond=True)
        purls = resolution.count()
        short = resolution.select("component_purl", "purl_number", "component")
        known = rows.join(F.broadcast(short), "component_purl") if purls <= factors.BROADCAST_ROWS else hashed_join(rows, short, ["component_purl"])
        known = known.drop("component_purl")
        keys = cat.entries.select("component", F.upper(strip_space(F.col("cve"))).alias("cve"), F.lit(True).alias("has_entry")).distinct()
        asked = hashed_join(known.where("component IS NOT NULL"), keys, ["component", "cve"], "left")
        bare = known.where("component IS NULL").withColumn("has_entry", F.lit(None).cast("boolean"))
        marked = stored(asked.unionByName(bare), beyond=True)
    return marked, resolution, purls


def of_entries(entry_symbols: DataFrame, keys: DataFrame) -> DataFrame:
    """The symbols of the entries `keys` (component, cve), ids as in findings.

    The condition is on plain columns of one side, so the entries are cut down before a join that lists their symbols.
    """
    cve = F.upper(strip_space(F.col("cve")))
    asked = keys.select(F.col("component").alias("__component"), F.col("cve").alias("__cve")).distinct()
    same = (F.col("component") == F.col("__component")) & (cve == F.col("__cve"))
    return entry_symbols.join(asked, same, "left_semi").withColumn("cve", cve)


def resolved_findings(findings: DataFrame, cat: Catalogue, ranges: DataFrame | None = None) -> DataFrame:
    """Findings with component, quality, entry facts and the early refusal if any.

    Unusable PURLs are left out here; `quarantine` lists them.  With `ranges` the version gate is on: an entry is no entry for
    findings whose version it does not affect.  The gate is off by default, as the described rules have none.
    """
    marked, resolution, purls = marked_findings(findings, cat)
    keys = marked.where("has_entry").select("component", "cve").distinct()
    facts = entry_facts(keys, of_entries(cat.entry_symbols, keys)).drop("n_symbols")
    found = hashed_join(marked.where("has_entry").drop("has_entry"), facts, ["component", "cve"])
    rest = marked.where("has_entry IS NULL").drop("has_entry")
    rest = rest.select("*", *(F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns[2:]))
    joined = factors.joined(found.unionByName(rest), resolution.drop("component"), purls, "purl_number")
    if ranges is not None:
        outside = outside_affected_versions(joined.where("has_entry"), ranges).withColumn("__outside", F.lit(True))
        gated = [F.when(F.col("__outside").isNull(), F.col(c)).alias(c) if c in facts.columns[2:] else c for c in joined.columns]
        joined = joined.join(outside, ["component", "cve", "component_purl"], "left").select(*gated)
    return joined.select(
        "artifact_id", "cve", "component_purl", "purl_type", "direct_quality", "quality", "component",
        "source_name", "alias_status", "identity_refusal", "has_entry", "n_definitive", "all_exported",
        early_refusal().alias("early_reason"),
    )


def quarantine(findings: DataFrame) -> DataFrame:
    """Findings whose PURL does not parse; they get no verdict."""
    parsed = P.with_purl(findings.select("component_purl").distinct(), "component_purl")
    bad = parsed.where(F.col("purl").isNull()).select("component_purl")
    return findings.join(bad, "component_purl", "left_semi").select(
        "artifact_id", "cve", "component_purl", F.lit("unparseable component_purl").alias("detail")
    )


# ------------------------------------------------------------- binary facts

def observable(symbols: DataFrame) -> DataFrame:
    """Distinct (artifact, inventory, symbol) over raw and normalised names."""
    names = F.array_distinct(F.array_compact(F.array(blank_to_null(F.col("raw")), blank_to_null(F.col("normalized")))))
    return symbols.select("artifact_id", "inventory_id", F.explode(names).alias("symbol"))


def _asked(rows: DataFrame, wanted: DataFrame | None, key: str) -> DataFrame:
    """Rows whose `key` occurs among the wanted (artifact, component) pairs; all without such a list.

    The keys are counted first: a short list is broadcast, so that symbols and strings are not shuffled to few artifacts.
    """
    if wanted is None:
        return rows
    keys = materialize(wanted.select(key).distinct())
    return factors.joined(rows, keys, keys.count(), key, "left_semi")


def _of_wanted(hits: DataFrame, wanted: DataFrame | None) -> DataFrame:
    return hits if wanted is None else hits.join(wanted, ["artifact_id", "component"], "left_semi")


def symbol_identity_hits(symbols: DataFrame, identity_symbols: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """First listed identity symbol each inventory shows per component."""
    listed = _asked(identity_symbols.select("component", "symbol", "position"), wanted, "component")
    found = observable(_asked(symbols, wanted, "artifact_id")).join(listed, "symbol")
    return (
        _of_wanted(found, wanted)
        .groupBy("artifact_id", "inventory_id", "component")
        .agg(F.min(F.struct("position", "symbol")).alias("first"))
        .select("artifact_id", "inventory_id", "component",
                F.concat(F.lit("symbol:"), F.col("first.symbol")).alias("reason"))
    )


def string_pattern_hits(ro_strings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct (artifact, inventory, pattern) with a read-only string that matches."""
    texts = ro_strings.select("artifact_id", "inventory_id", "value")
    return factors.matches(texts, patterns).select("artifact_id", "inventory_id", "pattern").distinct()


def string_identity_hits(ro_strings: DataFrame, identity_strings: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """First identity regex of each component that some read-only string matches."""
    listed = _asked(identity_strings.select("component", F.col("position").cast("bigint").alias("position"), "pattern"), wanted, "component")
    found = string_pattern_hits(_asked(ro_strings, wanted, "artifact_id"), listed).join(listed, "pattern")
    return (
        _of_wanted(found, wanted).groupBy("artifact_id", "inventory_id", "component")
        .agg(F.min(F.struct("position", "pattern")).alias("first"))
        .select("artifact_id", "inventory_id", "component",
                F.concat(F.lit("string:"), F.col("first.pattern")).alias("reason"))
    )


def identity_hits(facts: BinaryFacts, cat: Catalogue, wanted: DataFrame | None = None) -> DataFrame:
    """Both hit kinds; a regex hit counts only where no symbol hit exists."""
    by_symbol = symbol_identity_hits(facts.symbols, cat.identity_symbols, wanted).withColumn("kind", F.lit("symbol"))
    by_string = string_identity_hits(facts.ro_strings, cat.identity_strings, wanted).withColumn("kind", F.lit("string"))
    first = F.max(F.struct("kind", "reason"))  # "symbol" sorts after "string"
    return (
        by_symbol.unionByName(by_string).groupBy("artifact_id", "inventory_id", "component").agg(first.alias("hit"))
        .select("artifact_id", "inventory_id", "component", "hit.reason", "hit.kind")
    )


def component_inventories(facts: BinaryFacts, cat: Catalogue, wanted: DataFrame | None = None) -> DataFrame:
    """Inventories that carry a component, with the flags that can block a verdict.

    `wanted` (artifact_id, component) restricts the search to pairs that a finding asks about.
    """
    inv = facts.inventories.select("artifact_id", "inventory_id", "stripped", "static_linked", "has_dynamic")
    return identity_hits(facts, cat, wanted).join(inv, ["artifact_id", "inventory_id"], "left")


def identification(members: DataFrame) -> DataFrame:
    """Per (artifact, component): member count and the first blocking flag by inventory id."""
    blocked = (
        F.when(F.col("stripped") & F.col("static_linked"), "stripped_static_binary")
        .when(F.col("stripped") & ~F.col("static_linked") & ~F.col("has_dynamic"), "stripped_insufficient_dynsym")
    )
    return members.withColumn("__blocked", blocked).groupBy("artifact_id", "component").agg(
        F.count(F.lit(1)).alias("n_component_inventories"),
        F.min(F.when(F.col("__blocked").isNotNull(), F.struct("inventory_id", "__blocked")))["__blocked"]
        .alias("blocked_reason"),
    )


def usable_artifacts(inventories: DataFrame) -> DataFrame:
    """Per artifact: whether some inventory has a usable symbol table."""
    usable = S.usable_symbol_table(
        F.col("format"), F.col("stripped"), F.col("static_linked"), F.col("has_dynamic"), F.col("has_table")
    )
    return inventories.groupBy("artifact_id").agg(
        F.bool_or(usable).alias("any_usable"), F.count(F.lit(1)).alias("n_inventories")
    )


def listed_symbols(symbols: DataFrame, cat: Catalogue, wanted: DataFrame) -> DataFrame:
    """The observed names that some identity rule or definitive entry lists, of wanted (artifact, component) pairs; stored.

    The rules look at no other names, and what reads the binaries' words is by far the dearest step, so it is taken once.
    With a column `cve` in `wanted`, only these entries list names.
    """
    identity = _asked(cat.identity_symbols.select("component", "symbol"), wanted, "component").select("symbol")
    entry_symbols = of_entries(cat.entry_symbols, wanted) if "cve" in wanted.columns else cat.entry_symbols
    definitive = entry_symbols.where(F.col("confidence") == "definitive").select("symbol")
    listed = materialize(identity.unionByName(definitive).distinct())
    found = factors.joined(observable(_asked(symbols, wanted, "artifact_id")), listed, listed.count(), "symbol", "left_semi")
    return materialize(found.select("artifact_id", "inventory_id", F.col("symbol").alias("raw"), F.lit(None).cast("string").alias("normalized")))


def observed_definitive(symbols: DataFrame, entry_symbols: DataFrame) -> DataFrame:
    """Distinct (artifact, symbol) for symbols that some entry lists as definitive."""
    listed = entry_symbols.where(F.col("confidence") == "definitive").select("symbol").distinct()
    return observable(symbols).join(listed, "symbol", "left_semi").select("artifact_id", "symbol").distinct()


def _definitive_of(entry_symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(component, cve, symbol) of the definitive symbols of wanted entries."""
    definitive = of_entries(entry_symbols.where(F.col("confidence") == "definitive"), wanted)
    return definitive.select("component", "cve", "symbol")


def observed_per_entry(wanted: DataFrame, symbols: DataFrame, entry_symbols: DataFrame, cut: bool = False) -> DataFrame:
    """For each wanted (artifact, component, cve): its definitive symbols seen and not seen.

    The arrays hold at most the symbols of one reviewed entry.  `cut` says that `symbols` hold listed names only.
    """
    listed = _definitive_of(entry_symbols, wanted)
    shown = _asked(symbols, wanted, "artifact_id")
    found = observable(shown).select("artifact_id", "symbol").distinct() if cut else observed_definitive(
        shown, listed.select("symbol", F.lit("definitive").alias("confidence")))
    # Names are few to an artifact; the symbols of entries are many and meet them where they are.
    seen = stored(found.withColumn("__seen", F.lit(True)))
    checked = factors.joined(wanted.join(listed, ["component", "cve"]), seen, seen.count(), ["artifact_id", "symbol"], "left")
    return checked.groupBy("artifact_id", "component", "cve").agg(
        F.array_sort(F.collect_set(F.when(F.col("__seen"), F.col("symbol")))).alias("symbols_observed"),
        F.array_sort(F.collect_set(F.when(F.col("__seen").isNull(), F.col("symbol")))).alias("symbols_absent"),
    )


def observed_in_component(wanted: DataFrame, members: DataFrame, symbols: DataFrame, entry_symbols: DataFrame, cut: bool = False) -> DataFrame:
    """For each wanted (artifact, component, cve): its definitive symbols seen in binaries that carry the component.

    A diagnostic: the rules look at all binaries of an artifact, so a symbol of another library can decide.  `cut` says that
    `symbols` hold listed names only.
    """
    listed = _definitive_of(entry_symbols, wanted)
    own = members.select("artifact_id", "inventory_id", "component").distinct()
    carried = observable(_asked(symbols, own, "artifact_id"))
    if not cut:
        carried = carried.join(listed.select("symbol").distinct(), "symbol", "left_semi")
    seen = stored(carried.join(own, ["artifact_id", "inventory_id"]).select("artifact_id", "component", "symbol").distinct())
    return factors.joined(wanted.join(listed, ["component", "cve"]), seen, seen.count(), ["artifact_id", "component", "symbol"]).groupBy(
        "artifact_id", "component", "cve").agg(F.array_sort(F.collect_set("symbol")).alias("symbols_in_component_only"))


# ------------------------------------------------------------------ cascade

def verdict_columns() -> dict[str, Column]:
    """Rules over the joined facts, first match wins."""
    q = F.col("quality")
    identified = F.coalesce(F.col("n_component_inventories"), F.lit(0)) > 0
    usable = F.coalesce(F.col("any_usable"), F.lit(False))
    seen = F.coalesce(F.size("symbols_observed"), F.lit(0)) > 0
    refusal = (
        F.when(F.col("early_reason").isNotNull(), F.col("early_reason"))
        .when(~usable, "symbol_table_unusable")
        .when(~F.col("verified"), "provenance_unverified")
        .when(F.col("blocked_reason").isNotNull(), F.col("blocked_reason"))
        .when(~identified & (q == P.NAME_VERSION_ONLY), "identity_unverified")
    )
    rule = (
        F.when(refusal.isNotNull(), "D03")
        .when(seen, "D04")
        .when(identified & ~F.col("all_exported"), "D03")
        .when(identified, "D02")
        .when(usable & (q >= P.TYPE_NORMALIZED), "D01")
        .otherwise("D03")
    )
    late = F.when(refusal.isNotNull(), refusal).otherwise(
        F.when(rule == "D03", F.when(identified, "symbol_not_observable").otherwise("default_insufficient"))
    )
    return {"rule_id": rule, "reason_code": late}


def decide(findings: DataFrame, cat: Catalogue, facts: BinaryFacts, ranges: DataFrame | None = None) -> DataFrame:
    """One decision per finding with a usable PURL; `ranges` turns the version gate on.

    Inventory lists stay in `component_inventories`; here only their counts
    appear, because one artifact may hold any number of binaries.
    """
    resolved = resolved_findings(findings, cat, ranges)
    refused = resolved.where(F.col("has_entry").isNull()).select(
        *_KEPT, F.lit("D03").alias("rule_id"), F.col("early_reason").alias("reason_code"),
        F.lit(None).cast("bigint").alias("n_component_inventories"),
        F.lit(None).cast("array<string>").alias("symbols_observed"),
        F.lit(None).cast("array<string>").alias("symbols_absent"),
        F.lit(None).cast("array<string>").alias("symbols_in_component_only"),
    )
    # Rows with an entry carry evidence whatever the verdict, so all of them meet the symbols.
    open_rows = stored(resolved.where(F.col("has_entry").isNotNull()))
    wanted = stored(open_rows.select("artifact_id", "component", "cve").distinct())
    pairs = wanted.select("artifact_id", "component").distinct()
    verified = stored(cat.components.select(
        "component", (F.coalesce("provenance_status", F.lit("unverified")) == "verified").alias("verified")
    ))
    flags = stored(facts.inventories.select(
        "artifact_id", "inventory_id", "format", "stripped", "static_linked", "has_dynamic", "has_table"))
    facts = replace(facts, inventories=flags, symbols=listed_symbols(facts.symbols, cat, wanted))
    members = stored(component_inventories(facts, cat, pairs))
    usable, identified = stored(usable_artifacts(flags)), stored(identification(members))
    entry = ["artifact_id", "component", "cve"]
    own = observed_in_component(wanted, members, facts.symbols, cat.entry_symbols, cut=True)
    seen = observed_per_entry(wanted, facts.symbols, cat.entry_symbols, cut=True).join(own, entry, "left")
    late = factors.joined(open_rows, usable, usable.count(), "artifact_id", "left")
    late = factors.joined(late, verified, verified.count(), "component", "left")
    late = factors.joined(late, identified, identified.count(), ["artifact_id", "component"], "left")
    late = late.join(seen, entry, "left").select(
        *_KEPT, *[c.alias(k) for k, c in verdict_columns().items()],
        "n_component_inventories", "symbols_observed", "symbols_absent", own_symbols())
    return finish(refused.unionByName(late))


def own_symbols() -> Column:
    """An empty list where the entry's symbols were looked for and the component's binaries show none."""
    none = F.when(F.col("symbols_observed").isNotNull(), F.array().cast("array<string>"))
    return F.coalesce("symbols_in_component_only", none).alias("symbols_in_component_only")


_KEPT = ("artifact_id", "cve", "component_purl", "purl_type", "quality", "component", "source_name",
         "alias_status", "has_entry")


def finish(ruled: DataFrame) -> DataFrame:
    """Verdict, justification, labels and statement id from rule and reason."""
    rule = F.col("rule_id")
    return ruled.select(
        "artifact_id", "cve", "component_purl", "purl_type",
        F.when(rule == "D04", V.AFFECTED).when(rule.isin("D01", "D02"), V.NOT_AFFECTED)
        .otherwise(V.UNDER_INVESTIGATION).alias("verdict"),
        F.when(rule == "D01", V.COMPONENT_ABSENT).when(rule == "D02", V.CODE_ABSENT).alias("justification"),
        "rule_id", "reason_code", "quality", P.quality_label(F.col("quality")).alias("purl_match_quality"),
        "component", "source_name", "alias_status",
        statement_id(F.col("cve")).alias("statement_id"),
        F.coalesce("has_entry", F.lit(False)).alias("has_slice"),
        "n_component_inventories", "symbols_observed", "symbols_absent", "symbols_in_component_only",
    )


def forbidden_justifications(decisions: DataFrame) -> DataFrame:
    """Rows with a justification that must never be emitted; always empty."""
    return decisions.where(F.col("justification").isin(*V.FORBIDDEN_JUSTIFICATIONS))


def decision_records(decisions: DataFrame, bundle_root: str = "evidence") -> DataFrame:
    """The persisted record per finding; an evidence path only where a slice exists."""
    path = F.concat_ws("/", F.lit(bundle_root), F.col("artifact_id"), F.lit("statements"), F.col("statement_id"))
    return decisions.select(
        "artifact_id", "cve", "component_purl", "verdict", "rule_id", "reason_code", "justification",
        "component", "statement_id", F.when(F.col("has_slice"), path).alias("evidence_bundle"),
    )


def stages(decisions: DataFrame) -> DataFrame:
    """Decisions with the stage they stopped at."""
    stage = V.stage_id(F.col("verdict"), F.col("reason_code"))
    return decisions.withColumn("stage_id", stage).withColumn(
        "termination",
        F.when(V.is_decided(F.col("verdict")), "decided")
        .otherwise(F.coalesce(blank_to_null(F.col("reason_code")), F.lit("(missing reason_code)"))),
    )

