import glob
import json
import re
import time

from pyspark.sql import functions as F

from clearwright.operators import digests as DG
from clearwright.operators import evidence as E
from clearwright.sinks import vexdocs as X
from clearwright.sources.corpus import statements_from_files

ROWS = [
    ("a", "cve-2024-1", "CVE-2024-1", "pkg:generic/x@1?z=\"q", "NOT_AFFECTED", "component_not_present", "D01", None, "x"),
    ("a", "cve-2024-1", "CVE-2024-1", "pkg:generic/y", "NOT_AFFECTED", "component_not_present", "D01", None, "y"),
    ("a", "cve-2024-2", "CVE-2024-2", "pkg:generic/x@1", "AFFECTED", None, "D04", None, "x"),
    ("b", "cve-2024-3", "CVE-2024-3", "pkg:generic/z@2", "UNDER_INVESTIGATION", None, "D03", "symbol_table_unusable", "z"),
    ("c", "cve-2024-3", "CVE-2024-3", "pkg:generic/z@2", "AFFECTED", None, "D04", None, "z"),
]
SCHEMA = ("artifact_id string, statement_id string, cve string, component_purl string, verdict string, justification string, "
          "rule_id string, reason_code string, component string")


def inputs(spark, rows=ROWS):
    s = spark.createDataFrame(rows, SCHEMA)
    ids = s.select("artifact_id").distinct()
    return X.document_inputs(s, ids.withColumn("bundle_id", F.sha2("artifact_id", 256)), ids.withColumn("artifact_sha256", F.sha2("artifact_id", 256)), "1")


def written(lines, path):
    X.write_documents(lines, path)
    out = {}
    for a in ("a", "b", "c"):
        text = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/artifact_id={a}/part-*")))
        out[a] = json.loads(text)
    return out


def test_documents_are_whole_json(spark, tmp_path):
    i = inputs(spark)
    ov = written(X.openvex_lines(i), str(tmp_path / "o"))
    assert [s["vulnerability"]["name"] for s in ov["a"]["statements"]] == ["CVE-2024-1", "CVE-2024-1", "CVE-2024-2"]
    assert ov["b"]["statements"][0]["status"] == "under_investigation"
    cd = written(X.cyclonedx_lines(i), str(tmp_path / "c"))
    assert len(cd["a"]["components"]) == 3 and len(cd["a"]["vulnerabilities"]) == 3
    refs = {c["bom-ref"] for c in cd["a"]["components"]}
    assert all(v["affects"][0]["ref"] in refs for v in cd["a"]["vulnerabilities"])
    cs = written(X.csaf_lines(i), str(tmp_path / "s"))
    first = cs["a"]["vulnerabilities"][0]
    assert len(first["product_status"]["known_not_affected"]) == 2 and len(first["flags"]) == 2 and len(first["threats"]) == 2
    assert "flags" not in cs["c"]["vulnerabilities"][0] and len(cs["a"]["product_tree"]["branches"]) == 3
    rf = written(X.refusal_lines(i), str(tmp_path / "r"))
    assert rf["a"] == {"format": "refusals-v1", "bundle_id": rf["a"]["bundle_id"], "count": 0, "refusals": []}
    assert rf["b"]["count"] == 1 and rf["b"]["refusals"][0]["reason_code"] == "symbol_table_unusable"


def test_documents_do_not_depend_on_row_order(spark):
    a = sorted(map(tuple, X.openvex_lines(inputs(spark)).collect()))
    b = sorted(map(tuple, X.openvex_lines(inputs(spark, ROWS[::-1]).repartition(5)).collect()))
    assert a == b


def test_content_digest(spark):
    def digest(rows):
        df = spark.createDataFrame(rows, "k string, p string, h string")
        line = DG.artifact_line(F.col("p"), F.col("h"))
        return {r["k"]: r["digest"] for r in DG.content_digest(df, ["k"], line).collect()}

    rows = [("a", f"f{i}", str(i)) for i in range(300)]
    assert digest(rows) == digest(rows[::-1])
    assert digest(rows) != digest([*rows[:-1], ("a", "f299", "x")])


def test_verification_outcomes(spark):
    fresh = spark.createDataFrame(ROWS, SCHEMA)
    stored = fresh.withColumn("rule_id", F.when(F.col("artifact_id") == "c", "D02").otherwise(F.col("rule_id")))
    checks = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "artifact_id string, hashes_ok boolean")
    vex = fresh.where("cve = 'CVE-2024-1'").select(
        F.lower("cve").alias("vulnerability"), F.concat("component_purl", F.lit("?checksum=x")).alias("product_purl"),
        F.lit("not_affected").alias("status"), F.lit(None).cast("string").alias("justification"))
    got = {(r["artifact_id"], r["cve"], r["component_purl"]): r["verification"] for r in E.verify(stored, fresh, checks, vex).collect()}
    assert got[("a", "CVE-2024-1", "pkg:generic/y")] == "VERIFIED"
    assert got[("a", "CVE-2024-2", "pkg:generic/x@1")] == "MISMATCH"  # not in the VEX rows
    assert got[("b", "CVE-2024-3", "pkg:generic/z@2")] == "UNVERIFIABLE"
    assert got[("c", "CVE-2024-3", "pkg:generic/z@2")] == "MISMATCH"


def test_integrity_precedence(spark):
    cat = spark.createDataFrame([("n", "firmware", None), ("g", "firmware", "h"), ("m", "firmware", "h"), ("o", "firmware", "h")],
                                "artifact_id string, class string, sha256 string")
    disk = spark.createDataFrame([("n", "h"), ("m", "x"), ("o", "h")], "artifact_id string, actual_sha256 string")
    got = {r["artifact_id"]: r["outcome"] for r in E.integrity(cat, disk).collect()}
    assert got == {"n": "artifact-unhashed", "g": "artifact-absent", "m": "artifact-hash-mismatch", "o": "ok"}


def test_disclaimer_is_in_every_document(spark, tmp_path):
    i, said = inputs(spark), "not legal advice"
    docs = {name: written(lines(i, said), str(tmp_path / name))["a"] for name, lines in (
        ("o", X.openvex_lines), ("c", X.cyclonedx_lines), ("s", X.csaf_lines), ("r", X.refusal_lines))}
    assert docs["o"]["tooling"].endswith(said)
    assert docs["c"]["metadata"]["properties"] == [{"name": "clearwright:disclaimer", "value": said}]
    assert docs["c"]["metadata"]["tools"][0]["name"] == "clearwright"
    assert docs["s"]["document"]["notes"] == [{"category": "legal_disclaimer", "text": said}]
    assert docs["r"]["disclaimer"] == said


def test_commas_do_not_depend_on_ranges(spark):
    i = inputs(spark, [("abc"[k % 3], f"cve-{k // 4}", f"CVE-{k // 4}", f"pkg:generic/p{k}@{k}", *ROWS[k % 5][4:]) for k in range(60)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        texts = {}
        for parts in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for lines in (X.openvex_lines, X.cyclonedx_lines, X.csaf_lines, X.refusal_lines):
                rows = sorted(map(tuple, lines(i).drop("range").collect()))
                texts.setdefault(lines.__name__, []).append(rows)
        assert all(a == b for a, b in texts.values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lookups_have_a_row_each(spark):
    s = spark.createDataFrame([("a", "C1", "p1"), ("a", "C1", "p2"), ("a", "C2", "p1")], "artifact_id string, cve string, component_purl string")
    asked = [("a", "C1", None), ("a", "C1", None), ("a", "C1", "p2"), ("a", "C2", None), ("a", "C3", None), ("a", "C2", "p9")]
    got = E.find_statements(s, spark.createDataFrame(asked, "artifact_id string, cve string, wanted_purl string")).collect()
    assert sorted((r.cve, r.wanted_purl or "", r.matches, r.component_purl or "", r.outcome) for r in got) == [
        ("C1", "", 2, "p1", "ambiguous"), ("C1", "", 2, "p1", "ambiguous"), ("C1", "p2", 1, "p2", "found"), ("C2", "", 1, "p1", "found"),
        ("C2", "p9", 0, "", "none"), ("C3", "", 0, "", "none")]


def test_symbol_observations_search_no_strings(spark, monkeypatch):
    """The query returns observed symbols alone, so the identity regexes of all components are not tried for it."""
    from clearwright.operators import factors
    from clearwright.plans import catalog, evidence, views

    def searched(*_):
        raise AssertionError("strings were searched")

    sf = "/root/testdata/sf0.001"
    shown = views.symbols(spark, sf).groupBy("artifact_id", "normalized").count().orderBy(F.desc("count"), "artifact_id", "normalized").first()
    row = (shown.artifact_id, "S", "CVE-1", "pkg:generic/x", "AFFECTED", None, "D04", None, "x", None, [shown.normalized], [], True)
    made = spark.createDataFrame([row, (*row[:3], "pkg:generic/y", *row[4:])], SCHEMA + ", source_name string, symbols_observed array<string>, symbols_absent array<string>, has_slice boolean")
    monkeypatch.setattr(factors, "matches", searched)
    monkeypatch.setattr(evidence, "decisions", lambda *_: made)
    got = catalog.QUERIES["k03_symbol_observations"](spark, sf).collect()
    assert len(got) == 2 * shown["count"] and {(r.artifact_id, r.symbol) for r in got} == {(shown.artifact_id, shown.normalized)}


def test_slices_are_one_json_text_with_known_digests(spark):
    """The component's part is written once per component; fields without a value are left out as in one text."""
    import hashlib

    wanted = spark.createDataFrame([("x", "CVE-1"), ("x", "CVE-2"), ("y", "CVE-1"), ("z", "CVE-9")], "component string, cve string")
    components = spark.createDataFrame([("x", "verified"), ("y", None), ("z", "verified")], "component string, provenance_status string")
    symbols = spark.createDataFrame([("x", "CVE-1", "b", "definitive", True), ("x", "CVE-1", "a\"}", "probable", None), ("x", "CVE-2", "c", "definitive", False),
                                     ("y", "CVE-1", "d", "definitive", True)], "component string, cve string, symbol string, confidence string, dynsym_export_verified boolean")
    purls = spark.createDataFrame([("x", "f", 0, "pkg:generic/x")], "component string, source_file string, purl_pos int, purl_text string")
    names = spark.createDataFrame([("x", "s}", 1)], "component string, symbol string, position int")
    strings = spark.createDataFrame([("x", "p[}]", 0)], "component string, pattern string, position int")
    got = E.slices(wanted, components, symbols, purls, names, strings, "1")
    rows = {(r.component, r.cve): r for r in got.collect()}
    assert set(rows) == {("x", "CVE-1"), ("x", "CVE-2"), ("y", "CVE-1")}
    assert rows["y", "CVE-1"].slice == '{"version":"1","component":"y","cve":"CVE-1","vulnerable_symbols":[{"name":"d","confidence":"definitive","dynsym_export_verified":true}]}'
    assert json.loads(rows["x", "CVE-1"].slice) == {
        "version": "1", "component": "x", "provenance_status": "verified", "purls": [{"source_file": "f", "position": 0, "purl": "pkg:generic/x"}],
        "identity_symbols": [{"symbol": "s}", "position": 1}], "identity_strings": [{"pattern": "p[}]", "position": 0}], "cve": "CVE-1",
        "vulnerable_symbols": [{"name": 'a"}', "confidence": "probable"}, {"name": "b", "confidence": "definitive", "dynsym_export_verified": True}]}
    assert all(r.slice_sha256 == hashlib.sha256(r.slice.encode()).hexdigest() for r in rows.values())


def test_statements_are_found_below_long_folders_in_linear_time(spark):
    body, long = '{"cve":"CVE-2024-1","verdict":"AFFECTED"}', "x" * 200_000
    paths = [f"statements/{long}/statement.json", "statement.json", f"{long}/", "/statement.json"]
    files = spark.createDataFrame([("a", p, body) for p in paths], "artifact_id string, path string, body string")
    start = time.perf_counter()
    found = {r.folder: r.cve for r in statements_from_files(files).select("folder", "cve").collect()}
    assert time.perf_counter() - start < 20
    assert found == {f"statements/{long}": "CVE-2024-1", "statement.json": "CVE-2024-1", "": "CVE-2024-1"}


def test_vex_rows_are_met_by_a_hash_first(spark):
    s = spark.createDataFrame(ROWS, SCHEMA)
    vex = spark.createDataFrame([
        ("cve-2024-1", "pkg:generic/x@1?z=\"q", "not_affected", "COMPONENT_NOT_PRESENT"), ("cve-2024-1", "pkg:generic/y", "affected", None),
        ("CVE-2024-2", "pkg:generic/x@1?checksum=sha256:1", "affected", None), ("cve-2024-3", "pkg:generic/z@2", "affected", None),
        ("cve-2024-3", "pkg:generic/z@2", "affected", None)], "vulnerability string, product_purl string, status string, justification string")
    found = E.in_vex(s, vex)
    assert found.columns == s.columns
    assert sorted((r.artifact_id, r.component_purl) for r in found.collect()) == [("a", "pkg:generic/x@1"), ("a", 'pkg:generic/x@1?z="q'), ("c", "pkg:generic/z@2")]
    plan = E.in_vex(s, vex.hint("merge"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [__own" in plan


def test_decisions_are_not_shuffled_for_the_pack(spark):
    """Short lists of components and PURLs come to the decisions, whatever size the engine takes them for."""
    rows = spark.range(40).selectExpr(
        "'a' AS artifact_id", "'CVE-1' AS cve", "concat('pkg:npm/x', id) AS component_purl", "'UNDER_INVESTIGATION' AS verdict", "'D03' AS rule_id",
        "'why' AS reason_code", "CAST(NULL AS STRING) AS justification", "concat('x', id % 3) AS component", "'s' AS statement_id", "id % 2 = 0 AS has_slice",
        "1L AS n_component_inventories", "CAST(NULL AS ARRAY<STRING>) AS symbols_observed", "CAST(NULL AS ARRAY<STRING>) AS symbols_absent")
    components = spark.createDataFrame([("x0", "verified"), ("x1", None)], "component string, provenance_status string")
    identity = rows.selectExpr("component_purl", "'n' AS identity_source", "'direct' AS identity_status", "component AS identity_component").where("length(component_purl) = 10")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pack = E.evidence_pack(rows, components, identity)
        assert "hashpartitioning" not in pack._jdf.queryExecution().executedPlan().toString()
        got = {(r.component_purl, r.provenance, r.identity_component) for r in pack.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(f"pkg:npm/x{n}", "verified" if n % 6 == 0 else None, f"x{n % 3}" if n < 10 else None) for n in range(40)}


def test_vex_rows_meet_statements_by_numbers_of_purls(spark, monkeypatch):
    statements = spark.createDataFrame([
        ("a", "CVE-1", "pkg:npm/x@1", "AFFECTED", None), ("a", "CVE-1", "pkg:npm/x@1?checksum=sha256:00", "AFFECTED", None),
        ("b", "cve-1", " pkg:npm/x@1", "AFFECTED", None), ("a", "CVE-2", "pkg:npm/x@1", "AFFECTED", None), ("a", "CVE-1", "pkg:npm/y@1", "AFFECTED", None),
        ("a", "CVE-1", "pkg:npm/x@1", "NOT_AFFECTED", "vulnerable_code_not_present"), ("a", "CVE-1", None, "AFFECTED", None)],
        "artifact_id string, cve string, component_purl string, verdict string, justification string")
    vex = spark.createDataFrame([
        ("cve-1", "pkg:npm/x@1?checksum=sha256:11", "affected", None), ("CVE-1", "pkg:npm/x@1", "affected", None), ("CVE-3", "pkg:npm/y@1", "affected", None),
        ("CVE-1", None, "affected", None)], "vulnerability string, product_purl string, status string, justification string")
    numbered = E.in_vex(statements, vex)
    assert "number" in numbered._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(E, "BROADCAST_ROWS", 0)
    sorted_first = E.in_vex(statements, vex)
    want = sorted(map(repr, statements.collect()[:3]))
    assert [sorted(map(repr, x.collect())) for x in (numbered, sorted_first)] == [want, want] and numbered.columns == statements.columns


def test_statements_are_not_dealt_by_artifact_or_source_name(spark):
    """Few artifacts, and mostly no source name: neither may deal the statements with their slices to tasks."""
    rows = spark.createDataFrame(ROWS, SCHEMA).selectExpr(
        "*", "CASE WHEN artifact_id = 'b' THEN 'src' END AS source_name", "CAST(NULL AS ARRAY<STRING>) AS symbols_observed", "CAST(NULL AS ARRAY<STRING>) AS symbols_absent")
    slices = spark.createDataFrame([("x", "CVE-2024-1", "{}", "00")], "component string, cve string, slice string, slice_sha256 string")
    identities = spark.createDataFrame([("src", "{1}")], "source_name string, identity_slice string")
    hashes = spark.createDataFrame([("a", "11"), ("b", "22")], "artifact_id string, artifact_sha256 string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = E.statement_files(rows, slices, identities, hashes, "1")
        inputs = X.document_inputs(rows, hashes.selectExpr("artifact_id", "concat('b', artifact_id) AS bundle_id"), hashes, "1")
        for df in (files, inputs):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\((artifact_id|source_name|component_purl)#", plan)
        bodies = {(r.artifact_id, r.path.rpartition("/")[2]): r.body for r in files.collect() if r.path.endswith(("inputs.json", "identity-slice.json"))}
        got = {(r.artifact_id, r.bundle_id, r.artifact_sha256, r.component_purl, r.name, r.version) for r in inputs.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert bodies == {("a", "inputs.json"): '{"artifact_sha256":"11"}', ("b", "inputs.json"): '{"artifact_sha256":"22"}', ("c", "inputs.json"): "{}",
                      ("a", "identity-slice.json"): "{}", ("b", "identity-slice.json"): "{1}", ("c", "identity-slice.json"): "{}"}
    assert got == {("a", "ba", "11", ROWS[0][3], "x", "1"), ("a", "ba", "11", "pkg:generic/y", "y", ""), ("a", "ba", "11", "pkg:generic/x@1", "x", "1"),
                   ("b", "bb", "22", "pkg:generic/z@2", "z", "2")}


def test_symbols_are_listed_for_wanted_entries_only(spark):
    entries = spark.createDataFrame([("x", "CVE-1"), ("x", "CVE-2")], "component string, cve string")
    words = spark.createDataFrame([("x", "f"), ("x", "g")], "component string, symbol string")
    symbols = entries.join(words, "component").selectExpr("component", "cve", "symbol", "'definitive' AS confidence", "true AS dynsym_export_verified")
    none = spark.createDataFrame([], "component string, source_file string, purl_pos int, purl_text string, symbol string, position int, pattern string")
    cut = E.slices(entries.where("cve = 'CVE-2'"), spark.createDataFrame([("x", "verified")], "component string, provenance_status string"),
                   symbols, none.select("component", "source_file", "purl_pos", "purl_text"), none.select("component", "symbol", "position"),
                   none.select("component", "position", "pattern"), "1")
    assert [(r.cve, len(json.loads(r.slice)["vulnerable_symbols"])) for r in cut.collect()] == [("CVE-2", 2)]
    assert "LeftSemi" in cut._jdf.queryExecution().optimizedPlan().toString()


def test_statements_are_not_shuffled_to_their_observed_symbols(spark, monkeypatch):
    statements = spark.createDataFrame([("a", "CVE-1", "p", ["f", "g"]), ("a", "CVE-2", "p", ["f"]), ("b", "CVE-1", "q", None)],
                                       "artifact_id string, cve string, component_purl string, symbols_observed array<string>")
    symbols = spark.createDataFrame([("a", "bin/1", "_f", "f"), ("a", "bin/2", "f", "f"), ("a", "bin/2", "g", ""), ("a", "bin/2", "h", "h"), ("b", "bin/3", "f", "f")],
                                    "artifact_id string, inventory_id string, raw string, normalized string").selectExpr("*", "true AS defined", "'dyn_syms' AS table_kind")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        short = E.observed_symbols(statements, symbols)
        assert "Exchange hashpartitioning" not in short._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr("clearwright.operators.factors.BROADCAST_ROWS", 0)
        got = [sorted((r.cve, r.inventory_id, r.raw, r.symbol) for r in x.collect()) for x in (short, E.observed_symbols(statements, symbols))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == 2 * [[("CVE-1", "bin/1", "_f", "f"), ("CVE-1", "bin/2", "f", "f"), ("CVE-1", "bin/2", "g", "g"), ("CVE-2", "bin/1", "_f", "f"), ("CVE-2", "bin/2", "f", "f")]]
