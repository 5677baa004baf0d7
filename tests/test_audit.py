from clearwright.functions import purl as P
from clearwright.operators import audit as A


def test_statuses(spark):
    comps = P.with_purl(spark.createDataFrame([
        ("s", "pkg:generic/app@1", True), ("s", "pkg:deb/debian/lib@2", False), ("s", "pkg:generic/tool@3", False)],
        "sbom_id string, text string, is_root boolean"), "text")
    st = spark.createDataFrame([
        ("root", "s", "known_not_affected", ["pkg:generic/app@1"]), ("sub", "s", "", ["pkg:deb/debian/lib@2"]),
        ("inert", "s", None, ["pkg:generic/lib@2"]), ("bare", "s", "known_not_affected", ["pkg:generic/app"]),
        ("fixed", "s", "fixed", ["pkg:generic/app"]), ("both", "s", "", ["pkg:deb/debian/lib@2", "pkg:generic/app@1"]),
        ("gone", "s", "", ["pkg:generic/zzz@1"]), ("broken", "s", "", ["zzz"])],
        "statement_id string, sbom_id string, status string, products array<string>")
    got = {r["statement_id"]: r["audit_status"] for r in A.audit(st, comps).collect()}
    assert got == {"root": "ok", "sub": "overbroad", "inert": "inert", "bare": "versionless", "fixed": "ok", "both": "ok",
                   "gone": "inert", "broken": "versionless"}
    failed = A.has_failures(A.audit(st, comps)).first()
    assert failed["failed"] is True and failed["statements"] == 8


def test_roots(spark):
    rows = spark.createDataFrame([
        ("s", "top", "application", True), ("s", "a", "library", False), ("s", "app", "container", False), ("s", "dep", "device", False)],
        "sbom_id string, bom_ref string, type string, is_metadata boolean")
    edges = spark.createDataFrame([("s", "dep"), ("s", "a")], "sbom_id string, child_ref string")
    got = {r["bom_ref"]: r["is_root"] for r in A.root_flags(rows, edges).collect()}
    assert got == {"top": True, "a": False, "app": True, "dep": False}
