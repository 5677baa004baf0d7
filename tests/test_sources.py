import json

import pytest

from clearwright.sources import binaries as B
from clearwright.sources import corpus as C
from clearwright.sources import findings as SF
from clearwright.sources import sbom as SB
from clearwright.sources import vex as SV
from clearwright.sources.documents import read_documents


def docs(spark, **bodies):
    rows = [(k, b if isinstance(b, str) else json.dumps(b)) for k, b in bodies.items()]
    return spark.createDataFrame(rows, "doc_id string, content string")


def test_scan_reports_from_files(spark, tmp_path):
    (tmp_path / "g").write_text(json.dumps({"matches": []}))
    (tmp_path / "t").write_text(json.dumps({"Results": [{"Target": "x"}, {"Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "zlib"}]}]}))
    (tmp_path / "c").write_text(json.dumps([{"cve": "CVE-2", "name": "curl"}, {"cve": "CVE-3", "purl": "pkg:generic/a@1"}]))
    (tmp_path / "x").write_text(json.dumps({"other": 1}))
    d = read_documents(spark, str(tmp_path))
    got = {(r["artifact_id"], r["cve"], r["component_purl"]) for r in SF.load_findings(d).collect()}
    assert got == {("t", "CVE-1", "pkg:generic/zlib"), ("c", "CVE-2", "pkg:generic/curl"), ("c", "CVE-3", "pkg:generic/a@1")}
    assert [r["doc_id"] for r in SF.unrecognized(d).collect()] == ["x"]


def test_openvex_identifier_shapes(spark):
    d = docs(spark, a={"author": "x", "statements": [
        {"vulnerability": {"@id": "CVE-9"}, "products": [{"@id": "pkg:a/b", "identifiers": ["pkg:a/c", "cpe:x"]}], "status": "fixed"},
        {"vulnerability": {"name": "CVE-8"}, "products": [{"@id": "urn:x", "identifiers": {"purl": "pkg:a/d"}}], "status": "odd"}]})
    got = {r["vulnerability"]: (r["products"], r["status"]) for r in SV.load_vex(d).collect()}
    assert got == {"CVE-9": (["pkg:a/b", "pkg:a/c"], "fixed"), "CVE-8": (["pkg:a/d"], "odd")}


def test_csaf_deep_tree_and_chains(spark):
    def leaf(pid, purl):
        return {"product": {"product_id": pid, "name": pid, "product_identification_helper": {"purl": purl}}}

    tree = [{"branches": [{"branches": [{"branches": [{"branches": [leaf("deep", "pkg:a/deep@1")]}]}]}]}, leaf("dup", "pkg:a/first@1"), leaf("dup", "pkg:a/second@1")]
    rels = [{"product_reference": "c2", "relates_to_product_reference": "os", "full_product_name": {"product_id": "early"}},
            {"product_reference": "deep", "relates_to_product_reference": "os", "full_product_name": {"product_id": "c1"}},
            {"product_reference": "c1", "relates_to_product_reference": "os", "full_product_name": {"product_id": "c2"}}]
    d = docs(spark, a={"document": {}, "product_tree": {"branches": tree, "relationships": rels}, "vulnerabilities": [
        {"cve": "CVE-1", "product_status": {"fixed": ["c2", "dup", "early"]}}]})
    got = {r["product_id"]: (r["products"][0], r["indirect"]) for r in SV.csaf_statements(d).collect()}
    assert got == {"c2": ("pkg:a/deep@1", True), "dup": ("pkg:a/first@1", False)}


def test_branch_trees_of_any_shape():
    def leaf(pid):
        return {"product": {"product_id": pid, "product_identification_helper": {"purl": f"pkg:a/{pid}"}}}

    deep = [leaf("end")]
    for _ in range(200):
        deep = [{"branches": deep}]
    assert SV.branch_products(json.dumps(deep)) == [([0] * 201, "end", "pkg:a/end")]
    odd = [{"product": {"product_id": "", "name": "n"}}, {"product": 5, "branches": [leaf("x")]}, 7, None, {"product": {"product_id": 12}}]
    assert sorted(SV.branch_products(json.dumps(odd))) == [([0], "n", None), ([1, 0], "x", "pkg:a/x"), ([4], "12", None)]
    assert SV.branch_products(None) == SV.branch_products("{") == SV.branch_products('"x"') == SV.branch_products("[" * 100_000) == []


def test_csaf_chain_of_a_thousand_links_settles_in_log_rounds(spark, monkeypatch):
    rounds, store = [], SV.materialize
    n = 1000
    rels = [("d", [1, k], f"c{k}", f"c{k - 1}") for k in range(1, n)] + [("d", [1, n + 1], "late", "nobody"), ("d", [1, n + 2], "later", "late"),
            ("d", [1, n + 3], "twice", "nobody"), ("d", [1, n + 4], "twice", "c5"), ("d", [1, n + 5], "end", "twice"), ("d", [1, 0], "before", "c9")]
    open_rels = spark.createDataFrame([(*r[:3], "os", r[3]) for r in rels], "doc_id string, place array<int>, product_id string, platform string, reference string")
    direct = spark.createDataFrame([("d", "c0", "pkg:a/root@1", None, [0, 0], False)], "doc_id string, product_id string, purl_text string, platform string, place array<int>, indirect boolean")
    monkeypatch.setattr(SV, "materialize", lambda df: rounds.append(1) or store(df))
    got = {r.place[1]: r.purl_text for r in SV.settle(direct, open_rels).collect()}
    assert got == {**{k: "pkg:a/root@1" for k in range(1, n)}, n + 4: "pkg:a/root@1", n + 5: "pkg:a/root@1"}
    assert len(rounds) <= 18


def test_spdx_purpose_text_is_ignored(spark):
    d = docs(spark, a={"spdxVersion": "2.3", "packages": [{"name": "p", "SPDXID": "x", "primaryPackagePurpose": "LIBRARY",
             "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:a/p@1"}]}], "relationships": []})
    r = SB.load_sboms(d).first()
    assert r["name"] == "p" and r["is_root"] is True


def test_manifest_documents(spark, tmp_path):
    folder = tmp_path / "components" / "native"
    folder.mkdir(parents=True)
    (folder / "z.json").write_text(json.dumps({
        "component": {"name": "z", "ecosystem": "native", "purls": ["pkg:generic/z"], "identity_symbols": ["a", "b"]},
        "entries": [{"cve": "cve-2024-1", "affected_versions": ["<1"], "manifest_version": "1", "vulnerable_symbols": [{"name": "f", "confidence": "definitive"}]}]}))
    (folder / "a.json").write_text(json.dumps({"component": {"name": "a", "ecosystem": "native", "purls": [], "identity_symbols": []}, "entries": []}))
    t = C.manifest_tables(C.load_manifest_files(spark, str(tmp_path)))
    assert {r["component"] for r in t["components"].collect()} == {"a", "z"}
    assert [(r["component"], r["cve"], r["symbol"]) for r in t["entry_symbols"].collect()] == [("z", "CVE-2024-1", "f")]
    assert [(r["position"], r["symbol"]) for r in t["identity_symbols"].orderBy("position").collect()] == [(0, "a"), (1, "b")]


def test_decision_lines_take_the_folder_as_artifact(spark, tmp_path):
    (tmp_path / "art-1").mkdir()
    (tmp_path / "art-1" / "decisions.jsonl").write_text('{"cve":"CVE-1","verdict":"AFFECTED"}\n{broken\n')
    rows = C.load_decisions(spark, str(tmp_path), skip_broken=True).collect()
    assert [(r["artifact_id"], r["value"]) for r in C.broken_decisions(spark, str(tmp_path)).collect()] == [("art-1", "{broken")]
    with pytest.raises(Exception, match="MALFORMED"):
        C.load_decisions(spark, str(tmp_path)).collect()
    assert [(r["artifact_id"], r["cve"]) for r in rows] == [("art-1", "CVE-1")]


def test_binaries(spark, tmp_path):
    (tmp_path / "Lib.so").write_bytes(b"\x7fELF" + b"x" * 100)
    (tmp_path / "note.txt").write_text("hello")
    files = B.read_files(spark, str(tmp_path))
    assert [(r["format"], r["length"]) for r in B.file_inventory(files).collect()] == [("ELF", 104)]
    many = b"".join(b"constant %05d\0" % i for i in range(12_000)) + b"short\0"
    symbol = [("_inflate@@ZLIB_1.2", 1, 2, True, None)]
    sections = spark.createDataFrame([
        ("good", "aa", 62, False, True, ["libc.so.6"], None, bytearray(many), symbol, [], None),
        ("cut", "bb", 62, False, False, [], None, None, [], [], "elf_parse: short")], B.SECTIONS)
    rows = {r["path"]: r for r in B.inventory_facts(sections).collect()}
    good, cut = rows["good"], rows["cut"]
    assert (good["arch"], good["stripped"], good["static_linked"], good["needed"]) == ("amd64", True, False, ["libc.so.6"])
    s = good["dyn_syms"][0]
    assert (s["raw"], s["normalized"], s["version"], s["bind"], s["type"], s["defined"]) == ("_inflate", "inflate", "ZLIB_1.2", "GLOBAL", "FUNC", True)
    assert (cut["arch"], cut["stripped"], cut["static_linked"], cut["needed"]) == (None, None, None, None)
    strings = B.string_rows(sections)
    assert strings.count() == 12_000 and strings.where("position = 11999").first()["value"] == "constant 11999"


def test_positions_by_path(spark):
    rows = [(f"a{i % 2}", f"Bin/{(i * 37) % 101:03d}") for i in range(101)]
    got = B.positions_by_path(spark.createDataFrame(rows, "artifact_id string, path string").repartition(5)).collect()
    for a in ("a0", "a1"):
        paths = sorted(p for x, p in rows if x == a)
        assert sorted((r["position"], r["path"]) for r in got if r["artifact_id"] == a) == list(enumerate(paths, 1))
