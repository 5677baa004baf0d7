"""One hand-written finding per rule and refusal."""

import pytest
from pyspark.sql import functions as F

from clearwright.operators import decide as D


def frames(spark):
    comps, purls, entries, syms, ids, strs = [], [], [], [], [], []

    def comp(name, purl, status="verified", entry="definitive", exported=True):
        comps.append((name, status))
        purls.append((name, f"components/{name}.json", 0, purl))
        ids.append((name, f"id_{name}", 0))
        strs.append((name, 0, f"banner {name} [0-9]"))
        if entry:
            entries.append((name, "CVE-2024-0001"))
            syms.append((name, "CVE-2024-0001", f"vuln_{name}", entry, exported))

    comp("absent", "pkg:generic/absent")
    comp("clean", "pkg:generic/clean")
    comp("hidden", "pkg:generic/hidden", exported=False)
    comp("hit", "pkg:generic/hit")
    comp("unread", "pkg:generic/unread")
    comp("unverified", "pkg:generic/unverified", status=None)
    comp("noentry", "pkg:generic/noentry", entry=None)
    comp("probable", "pkg:generic/probable", entry="probable")
    comp("weak", "pkg:generic/weak@1")
    comp("blockstatic", "pkg:generic/blockstatic")
    comp("blockdyn", "pkg:generic/blockdyn")
    comp("mapped", "pkg:generic/mapped")
    cat = D.Catalogue(
        spark.createDataFrame(comps, "component string, provenance_status string"),
        spark.createDataFrame(purls, "component string, source_file string, purl_pos int, purl_text string"),
        spark.createDataFrame(entries, "component string, cve string"),
        spark.createDataFrame(syms, "component string, cve string, symbol string, confidence string, dynsym_export_verified boolean"),
        spark.createDataFrame([("msrc", "pkg:generic/mapped", "definitive"), ("psrc", "pkg:generic/mapped", "probable")],
                              "source_name string, component string, status string"),
        spark.createDataFrame(ids, "component string, symbol string, position int"),
        spark.createDataFrame(strs, "component string, position int, pattern string"),
    )
    inv = [("art", "bin/a", "ELF", False, False, True, True), ("art", "bin/static", "ELF", True, True, False, False),
           ("art", "bin/dyn", "ELF", True, False, False, False), ("dark", "bin/x", "ELF", True, True, False, False)]
    sym = [("art", "bin/a", s) for s in ("id_clean", "id_hidden", "__wrap_id_hit", "_vuln_hit", "id_unverified")]
    ro = [("art", "bin/static", "banner blockstatic 1"), ("art", "bin/dyn", "x banner blockdyn 2"), ("art", "bin/a", "banner clean 9")]
    facts = D.BinaryFacts(
        spark.createDataFrame(inv, "artifact_id string, inventory_id string, format string, stripped boolean, static_linked boolean, has_dynamic boolean, has_table boolean"),
        spark.createDataFrame(sym, "artifact_id string, inventory_id string, raw string").selectExpr(
            "*", "regexp_replace(raw, '^(__wrap_|__real_|_(?!_))+', '') AS normalized"),
        spark.createDataFrame(ro, "artifact_id string, inventory_id string, value string"))
    return cat, facts


CASES = {
    ("art", "pkg:generic/absent@1"): "D01", ("art", "pkg:generic/clean@1"): "D02", ("art", "pkg:generic/hit@1"): "D04",
    ("art", "pkg:generic/hidden@1"): "symbol_not_observable", ("dark", "pkg:generic/unread@1"): "symbol_table_unusable",
    ("art", "pkg:generic/unverified@1"): "provenance_unverified", ("art", "pkg:generic/noentry@1"): "manifest_no_entry",
    ("art", "pkg:generic/probable@1"): "manifest_probable_only", ("art", "pkg:npm/weak@1"): "identity_unverified",
    ("art", "pkg:generic/blockstatic@1"): "stripped_static_binary", ("art", "pkg:generic/blockdyn@1"): "stripped_insufficient_dynsym",
    ("art", "pkg:deb/debian/libm@1-2?upstream=msrc"): "D01", ("art", "pkg:deb/debian/libm@1-2?upstream=psrc"): "mapping_probable_only",
    ("art", "pkg:deb/debian/libm@1-2?upstream=other"): "no_identity_mapping", ("art", "pkg:deb/debian/libm@1-2"): "no_identity_mapping",
    ("art", "pkg:deb/debian/libm@%25?upstream=msrc"): "version_underivable", ("art", "pkg:generic/nothing@1"): "purl_match_insufficient",
}


def run(spark):
    cat, facts = frames(spark)
    raw = spark.createDataFrame([(a, " cve-2024-0001", p) for a, p in CASES] + [("art", "CVE-2024-0001", "broken")],
                                "artifact_id string, cve string, component_purl string")
    return D.normalize_findings(raw), cat, facts


def outcomes(df):
    return {(r["artifact_id"], r["component_purl"]): r["reason_code"] or r["rule_id"] for r in df.collect()}


def test_every_outcome(spark):
    f, cat, facts = run(spark)
    assert outcomes(D.decide(f, cat, facts)) == CASES
    assert [r["component_purl"] for r in D.quarantine(f).collect()] == ["broken"]


def test_shuffle_joins_give_the_same_answer(spark):
    """Past the broadcast bound nothing changes."""
    f, cat, facts = run(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert outcomes(D.decide(f, cat, facts)) == CASES
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quality_and_evidence_columns(spark):
    f, cat, facts = run(spark)
    rows = {r["component_purl"]: r for r in D.decide(f, cat, facts).collect()}
    mapped = rows["pkg:deb/debian/libm@1-2?upstream=msrc"]
    assert mapped["purl_match_quality"] == "identity_mapped" and mapped["component"] == "mapped"
    assert rows["pkg:generic/hit@1"]["symbols_observed"] == ["vuln_hit"]
    assert rows["pkg:generic/clean@1"]["symbols_absent"] == ["vuln_clean"]
    assert rows["pkg:generic/clean@1"]["justification"] == "vulnerable_code_not_present"
    assert rows["pkg:generic/noentry@1"]["has_slice"] is False


def test_patterns_with_and_without_literals_find_the_same_strings(spark):
    import re

    strings = ["zlib 1.2.3", "xzlib 99", "Zlib 1", "deflate 1.0 zlib", "aaa", "", None, "OpenSSL 3.0.1", "a.b", "libpng version 1.6", "zlib 1" * 3]
    patterns = ["zlib [0-9]+", "(?i)zlib", "OpenSSL [0-9.]+", "libpng|deflate", "aa", "libpng version", "^OpenSSL", "zlib 1.2?"]
    left = spark.createDataFrame([("a", str(i), v) for i, v in enumerate(strings)], "artifact_id string, inventory_id string, value string")
    got = D.string_pattern_hits(left, spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()
    assert sorted((int(r.inventory_id), r.pattern) for r in got) == sorted((i, p) for i, v in enumerate(strings) for p in patterns if v is not None and re.search(p, v))


@pytest.mark.parametrize("verdict,reason,stage", [("AFFECTED", None, "S7"), ("UNDER_INVESTIGATION", "symbol_not_observable", "S5b"),
                                                  ("UNDER_INVESTIGATION", "odd", "S?"), ("UNDER_INVESTIGATION", None, "S?")])
def test_stages(spark, verdict, reason, stage):
    df = spark.createDataFrame([(verdict, reason)], "verdict string, reason_code string")
    assert D.stages(df).first()["stage_id"] == stage


def test_words_of_binaries_are_read_once(spark):
    """One pass over the symbols for identity, observed and own symbols, and only the listed names leave it."""
    findings, cat, facts = run(spark)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    more = facts.symbols.unionByName(facts.symbols.selectExpr("artifact_id", "inventory_id", "concat(raw, '_other') AS raw", "concat(normalized, '_other') AS normalized"))
    one = more.coalesce(1).mapInArrow(counted, more.schema)
    assert outcomes(D.decide(findings, cat, D.BinaryFacts(facts.inventories, one, facts.ro_strings))) == {k: v for k, v in CASES.items()}
    assert reads.value == more.count()
    pairs = findings.select("artifact_id").distinct().crossJoin(cat.components.select("component"))
    assert {r.raw for r in D.listed_symbols(more, cat, pairs).collect()} == {"id_clean", "id_hidden", "id_hit", "vuln_hit", "id_unverified"}


def test_texts_that_begin_alike_are_joined_by_a_hash_first(spark):
    left = spark.createDataFrame([("a", "pkg:x"), ("b", "pkg:y"), ("c", None)], "artifact_id string, component_purl string")
    right = spark.createDataFrame([("pkg:x", 1), (None, 2)], "component_purl string, quality int")
    joined = D.hashed_join(left, right, ["component_purl"], "left")
    assert sorted((r.artifact_id, r.component_purl, r.quality) for r in joined.collect()) == [("a", "pkg:x", 1), ("b", "pkg:y", None), ("c", None, None)]
    plan = D.hashed_join(left, right.hint("merge"), ["component_purl"])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [__hash" in plan


def test_symbols_of_one_entry_are_counted_over_all_texts_of_its_id(spark):
    entries = spark.createDataFrame([("x", "CVE-1"), ("x", "CVE-2"), ("x", "CVE-3")], "component string, cve string")
    listed = spark.createDataFrame([
        ("x", "cve-1 ", "a", "definitive", True), ("x", "CVE-1", "b", "definitive", None), ("x", "CVE-1", "c", "probable", False),
        ("x", " cve-2", "a", "definitive", True), ("x", "CVE-2", "b", "probable", False)],
        "component string, cve string, symbol string, confidence string, dynsym_export_verified boolean")
    facts = {r.cve: (r.n_symbols, r.n_definitive, r.all_exported) for r in D.entry_facts(entries, listed).collect()}
    assert facts == {"CVE-1": (3, 2, False), "CVE-2": (2, 1, True), "CVE-3": (0, 0, False)}


def test_purl_texts_stay_out_of_the_shuffle_to_entries(spark, monkeypatch):
    """Findings meet entries by a number of their PURL, with a broadcast of the PURLs or without."""
    findings, cat, facts = run(spark)
    marked, resolution, purls = D.marked_findings(findings, cat)
    assert set(marked.columns) == {"artifact_id", "cve", "component", "purl_number", "has_entry"}
    assert resolution.select("purl_number").distinct().count() == purls == len({p for _, p in CASES})
    resolved = D.resolved_findings(findings, cat)
    monkeypatch.setattr(D.factors, "BROADCAST_ROWS", 0)
    shuffled = D.resolved_findings(findings, cat)
    assert sorted(map(repr, resolved.collect())) == sorted(map(repr, shuffled.collect()))


def test_entries_are_cut_down_before_their_symbols_are_listed(spark):
    entries = spark.createDataFrame([("x", " cve-1"), ("x", "CVE-2"), ("y", "CVE-1")], "component string, cve string")
    words = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "component string, symbol string")
    keys = spark.createDataFrame([("x", "CVE-1"), ("x", "CVE-1")], "component string, cve string")
    cut = D.of_entries(entries.join(words, "component").select("component", "cve", "symbol"), keys)
    assert sorted(map(tuple, cut.collect())) == [("x", "CVE-1", "a"), ("x", "CVE-1", "b")]
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Inner") < plan.index("LeftSemi")
