"""Stored evidence derived again, on the hand-written findings of every rule."""

from pyspark.sql import functions as F
from test_decide import run

from clearwright.operators import decide as D
from clearwright.operators import evidence as E
from clearwright.operators import metrics as M
from clearwright.operators.replay import replay
from clearwright.sources.corpus import statements_from_files


def evidence(spark):
    findings, cat, facts = run(spark)
    decided = D.decide(findings, cat, facts)
    rows = E.evidence_statements(decided)
    slices = E.slices(rows.select("component", "cve").distinct(), cat.components, cat.entry_symbols, cat.component_purls, cat.identity_symbols, cat.identity_strings, "1")
    hashes = decided.select("artifact_id", F.sha2("artifact_id", 256).alias("artifact_sha256")).distinct()
    return rows, E.statement_files(rows, slices, E.identity_slices(cat.aliases), hashes, "1"), facts


def keyed(df, *columns):
    return {(r.artifact_id, r.component_purl): tuple(r[c] for c in columns) for r in df.collect()}


def test_every_verdict_is_found_again(spark):
    rows, files, facts = evidence(spark)
    columns = ("verdict", "justification", "rule_id", "reason_code", "component")
    want = keyed(rows, *columns)
    assert keyed(replay(statements_from_files(files), facts), *columns) == want
    assert any("libm@" in purl for _, purl in want) and {"D01", "D02", "D03", "D04"} == {v[2] for v in want.values()}


def test_a_changed_slice_changes_its_own_statement_only(spark):
    rows, files, facts = evidence(spark)
    body = F.when(F.col("body").contains('"vuln_hit"'), F.replace("body", F.lit('"vuln_hit"'), F.lit('"vuln_other"'))).otherwise(F.col("body"))
    changed = files.withColumn("body", F.when(F.col("path").endswith("manifest-slice.json"), body).otherwise(F.col("body")))
    before, after = (keyed(replay(statements_from_files(f), facts), "rule_id") for f in (files, changed))
    moved = {k for k in before if before[k] != after[k]}
    assert moved and all("/hit" in k[1] for k in moved)


def test_without_its_alias_row_a_mapped_verdict_falls(spark):
    rows, files, facts = evidence(spark)
    bare = files.withColumn("body", F.when(F.col("path").endswith("identity-slice.json"), F.lit("{}")).otherwise(F.col("body")))
    got = keyed(replay(statements_from_files(bare), facts), "reason_code")
    assert {v[0] for k, v in got.items() if "libm@" in k[1]} == {"no_identity_mapping"}


def test_verification_with_a_vex_side(spark):
    rows, files, facts = evidence(spark)
    stored = statements_from_files(files)
    checks = rows.select("artifact_id").distinct().withColumn("hashes_ok", F.lit(True))
    fresh = replay(stored, facts)
    assert {r.verification for r in E.verify(stored, fresh, checks).collect()} == {"VERIFIED"}
    vex = rows.where("verdict = 'AFFECTED'").select(F.col("cve").alias("vulnerability"), F.col("component_purl").alias("product_purl"), F.lit("affected").alias("status"), F.lit(None).cast("string").alias("justification"))
    got = {r.component_purl: r.verification for r in E.verify(stored, fresh, checks, vex).collect()}
    assert got["pkg:generic/hit@1"] == "VERIFIED" and set(got.values()) == {"VERIFIED", "MISMATCH"}


def test_changed_folders(spark):
    _, files, _ = evidence(spark)
    one = files.where(F.col("path").endswith("statement.json")).orderBy("path").first()
    after = files.withColumn("sha256", F.when(F.col("path") == one.path, F.lit("x")).otherwise(F.col("sha256")))
    got = [tuple(r) for r in E.changed_folders(files, after).collect()]
    assert got == [(one.artifact_id, one.path.rsplit("/", 1)[0])]
    assert E.changed_folders(files, files).count() == 0


def test_symbols_in_the_component_only(spark):
    findings, cat, facts = run(spark)
    got = {r.component_purl: r.symbols_in_component_only for r in D.decide(findings, cat, facts).where("has_slice").collect()}
    assert got["pkg:generic/hit@1"] == ["vuln_hit"] and got["pkg:generic/clean@1"] == []


def test_library_carriers_by_closure(spark):
    files = spark.createDataFrame([("a", p) for p in ("lib/x.so", "lib/y.so", "bin/p", "bin/q", "bin/r")] + [("b", "bin/p")], "artifact_id string, path string")
    needed = spark.createDataFrame([("a", "lib/y.so", "x.so"), ("a", "bin/p", "y.so"), ("a", "bin/q", "libc.so"), ("a", "lib/x.so", "y.so"), ("b", "bin/p", "x.so")], "artifact_id string, path string, needed string")
    carriers = M.library_carriers(files, needed, F.col("path").endswith("x.so"))
    assert {(r.artifact_id, r.path, r.is_library) for r in carriers.collect()} == {("a", "lib/x.so", True), ("a", "lib/y.so", False), ("a", "bin/p", False)}
    matched = spark.createDataFrame([("a",), ("c",)], "artifact_id string")
    assert sorted(map(tuple, M.artifacts_with_library(matched, carriers).collect())) == [("a", 1, 3), ("c", 0, 0)]

