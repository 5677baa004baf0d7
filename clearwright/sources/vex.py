"""OpenVEX, CycloneDX VEX and CSAF documents as statement rows.

Statement columns: doc_id, vulnerability, products, product_id, platform, status,
justification, indirect.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.functions.text import blank_to_null, strip_space
from clearwright.functions.verdict import vex_status_key
from clearwright.operators.tables import materialize

_PRODUCT = "STRUCT<`@id`: STRING, purl: STRING, identifiers: STRING>"
OPENVEX = (f"statements ARRAY<STRUCT<vulnerability: STRUCT<name: STRING, `@id`: STRING>, products: ARRAY<{_PRODUCT}>, "
           "status: STRING, justification: STRING>>")
CYCLONEDX_VEX = ("vulnerabilities ARRAY<STRUCT<id: STRING, affects: ARRAY<STRUCT<ref: STRING>>, analysis: STRUCT<state: STRING>>>, "
                 "components ARRAY<STRUCT<`bom-ref`: STRING, purl: STRING>>")
_HELPER = "STRUCT<purl: STRING>"
CSAF = ("vulnerabilities ARRAY<STRUCT<cve: STRING, product_status: MAP<STRING, ARRAY<STRING>>, flags: ARRAY<STRUCT<label: STRING, "
        "product_ids: ARRAY<STRING>>>>>, product_tree STRUCT<branches: STRING, relationships: ARRAY<STRUCT<product_reference: STRING, "
        f"relates_to_product_reference: STRING, full_product_name: STRUCT<name: STRING, product_id: STRING, product_identification_helper: {_HELPER}>>>>")
NATIVE = "format STRING, statements ARRAY<STRUCT<cve: STRING, purl: STRING, status: STRING, justification: STRING>>"


def vex_format(content: Column) -> Column:
    def has(path: str) -> Column:
        return F.get_json_object(content, path).isNotNull()

    return (
        F.when(has("$['@context']") | (has("$.statements") & has("$.author")), "openvex")
        .when(has("$.bomFormat"), "cyclonedx")
        .when(has("$.document") | (has("$.vulnerabilities") & has("$.product_tree")), "csaf")
        .otherwise("unrecognized")
    )


def _identifiers(text: Column) -> Column:
    """Identifiers come as a list of texts or as an object with a PURL."""
    none = F.array().cast("array<string>")
    return (
        F.when(text.startswith("["), F.coalesce(F.from_json(text, "ARRAY<STRING>"), none))
        .when(text.startswith("{"), F.array_compact(F.array(F.get_json_object(text, "$.purl"))))
        .otherwise(none)
    )


def _product_texts(p: Column) -> Column:
    ids = F.filter(F.concat(F.array(p["@id"]), _identifiers(p["identifiers"])), lambda x: x.startswith("pkg:"))
    return F.concat(F.array_compact(F.array(blank_to_null(p["purl"]))), ids)


def openvex_statements(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.explode(F.from_json("content", OPENVEX)["statements"]).alias("s"))
    products = F.array_distinct(F.flatten(F.transform("s.products", _product_texts)))
    return _plain(rows.select(
        "doc_id",
        F.coalesce(blank_to_null(F.col("s.vulnerability.name")), F.col("s.vulnerability.`@id`")).alias("vulnerability"),
        products.alias("products"), vex_status_key(F.col("s.status")).alias("status")))


def cyclonedx_statements(docs: DataFrame) -> DataFrame:
    """`affects.ref` is a PURL, or a component reference looked up in the same document."""
    d = docs.select("doc_id", F.from_json("content", CYCLONEDX_VEX).alias("d"))
    known = d.select("doc_id", F.posexplode("d.components").alias("pos", "c")).select(
        "doc_id", F.col("c.`bom-ref`").alias("ref"), F.col("c.purl").alias("purl"), "pos",
    ).where((F.coalesce("ref", F.lit("")) != "") & (F.coalesce("purl", F.lit("")) != "")).groupBy("doc_id", "ref").agg(
        F.max_by("purl", "pos").alias("purl"))
    vulns = d.select("doc_id", F.posexplode("d.vulnerabilities").alias("vpos", "v"))
    refs = vulns.select("doc_id", "vpos", F.col("v.id").alias("vulnerability"), F.col("v.analysis.state").alias("state"),
                        F.posexplode("v.affects").alias("apos", "a")).withColumn("ref", F.col("a.ref"))
    found = refs.join(known, ["doc_id", "ref"], "left").withColumn(
        "product", F.when(F.col("ref").startswith("pkg:"), F.col("ref")).otherwise(F.col("purl")))
    # One document's vulnerability lists its products; the array stays within that entry.
    grouped = found.where(F.col("product").isNotNull()).groupBy("doc_id", "vpos", "vulnerability", "state").agg(
        F.array_sort(F.collect_list(F.struct("apos", "product"))).alias("ps"))
    return _plain(grouped.select(
        "doc_id", "vulnerability", F.array_distinct(F.transform("ps", lambda x: x["product"])).alias("products"),
        F.coalesce(vex_status_key(F.col("state")), F.lit("")).alias("status")))


def _plain(rows: DataFrame) -> DataFrame:
    missing = F.lit(None).cast("string")
    return rows.where(F.size("products") > 0).select(
        "doc_id", "vulnerability", "products", missing.alias("product_id"), missing.alias("platform"), "status",
        missing.alias("justification"), F.lit(False).alias("indirect"))


# --------------------------------------------------------------------- CSAF

def branch_products(text: str | None) -> list[tuple[list[int], str | None, str | None]]:
    """(place, product id, PURL) of every product in a branch tree's JSON text, whatever its depth; none where it cannot be read."""
    def words(value) -> str | None:
        return value if value is None or isinstance(value, str) else json.dumps(value)

    def field(value, name: str):
        return value.get(name) if isinstance(value, dict) else None

    try:
        open_ = [([], json.loads(text or "null"))]
    except (ValueError, RecursionError):
        return []
    found = []
    while open_:
        place, branches = open_.pop()
        for n, branch in enumerate(branches if isinstance(branches, list) else []):
            product = field(branch, "product")
            if isinstance(product, dict):
                own = words(product.get("product_id"))
                named = own if own and own.strip() else words(product.get("name"))
                found.append(([*place, n], named, words(field(product.get("product_identification_helper"), "purl"))))
            if field(branch, "branches") is not None:
                open_.append(([*place, n], branch["branches"]))
    return found


def csaf_branch_products(trees: DataFrame) -> DataFrame:
    """Every product of the branch trees (doc_id, branches), with its place in document order; one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *p) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("branches").to_pylist()) for p in branch_products(text)]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (batch.schema.field("doc_id").type, pa.list_(pa.int32()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "place", "product_id", "purl_text"])

    kind = trees.schema["doc_id"].dataType.simpleString()
    return trees.select("doc_id", "branches").mapInArrow(run, f"doc_id {kind}, place array<int>, product_id string, purl_text string")


def first_registrations(regs: DataFrame) -> DataFrame:
    """First registration of an id wins; equal PURLs later fill an empty platform."""
    first = regs.groupBy("doc_id", "product_id").agg(F.min(F.struct("place", "purl_text")).alias("f")).select(
        "doc_id", "product_id", F.col("f.purl_text").alias("purl_text"), F.col("f.place").alias("first_place"))
    same = regs.join(first.hint("merge"), ["doc_id", "product_id", "purl_text"])
    return same.groupBy("doc_id", "product_id", "purl_text", "first_place").agg(
        F.min(F.when(F.coalesce("platform", F.lit("")) != "", F.struct("place", "platform")))["platform"].alias("platform"),
        F.bool_or("indirect").alias("indirect"))


def csaf_products(docs: DataFrame) -> DataFrame:
    """product_id to PURL per document, with relationships resolved against earlier ids only.

    A composite id without its own PURL takes that of the product it refers to.  `settle` follows such references.
    Joins here and there shuffle both sides: documents unpack to far more than the size guessed from their files,
    and a side that is broadcast for that guess goes through the driver whole.
    """
    d = docs.select("doc_id", F.from_json("content", CSAF)["product_tree"].alias("t"))
    branches = csaf_branch_products(d.select("doc_id", F.col("t.branches").alias("branches"))).select(
        "doc_id", "product_id", "purl_text", F.lit(None).cast("string").alias("platform"),
        F.concat(F.array(F.lit(0)), "place").alias("place"), F.lit(False).alias("indirect"))
    rels = d.select("doc_id", F.posexplode("t.relationships").alias("pos", "r")).select(
        "doc_id", F.array(F.lit(1), F.col("pos")).alias("place"),
        F.col("r.full_product_name.product_id").alias("product_id"), F.col("r.relates_to_product_reference").alias("platform"),
        blank_to_null(strip_space(F.col("r.full_product_name.product_identification_helper.purl"))).alias("purl_text"),
        F.col("r.product_reference").alias("reference"))
    names = ["doc_id", "product_id", "purl_text", "platform", "place", "indirect"]
    direct = materialize(_usable(branches.unionByName(
        rels.where(F.col("purl_text").isNotNull()).withColumn("indirect", F.lit(False)).select(*names))))
    open_rels = materialize(rels.where(F.col("purl_text").isNull()).withColumn("product_id", strip_space(F.col("product_id"))).where(
        F.coalesce("product_id", F.lit("")) != "").drop("purl_text"))
    resolved = open_rels.join(settle(direct, open_rels).hint("merge"), ["doc_id", "place"]).withColumn("indirect", F.lit(True)).select(*names)
    return first_registrations(direct.unionByName(resolved)).drop("first_place")


def settle(direct: DataFrame, open_rels: DataFrame) -> DataFrame:
    """(doc_id, place, purl_text) of the open relationships that resolve.

    A relationship takes the first registration of the id it refers to, if that stands earlier.  That is a product with
    a PURL, or another open relationship, which it points to; pointers are doubled, so a chain of n links settles in
    about log2(n) rounds, each over the unsettled rows only.  A chain that ends nowhere registers nothing; where an
    id on it has a further registration, the dead ends are left out and those rows look again.
    """
    known = direct.groupBy("doc_id", F.col("product_id").alias("reference")).agg(
        F.min("place").alias("place"), F.min_by("purl_text", "place").alias("purl_text"), F.lit(1).alias("n"))
    live = open_rels.select("doc_id", F.col("product_id").alias("reference"), "place", F.lit(None).cast("string").alias("purl_text"), F.lit(1).alias("n"))
    asking, settled = open_rels.select("doc_id", "place", "reference"), None
    while True:
        first = known.unionByName(live).groupBy("doc_id", "reference").agg(
            F.min(F.struct("place", "purl_text")).alias("f"), F.sum("n").alias("n"))
        found = asking.join(first.hint("merge"), ["doc_id", "reference"], "left")
        earlier = F.coalesce(F.col("f.place") < F.col("place"), F.lit(False))
        rows = found.select(
            "doc_id", "place", "reference", F.when(earlier, F.col("f.purl_text")).alias("purl_text"),
            F.when(earlier & F.col("f.purl_text").isNull(), F.col("f.place")).alias("target"), (earlier & (F.col("n") > 1)).alias("again"))
        rows = _followed(materialize(rows if settled is None else rows.unionByName(settled)))
        lost = rows.where(F.col("purl_text").isNull())
        if lost.where("again").isEmpty():
            return rows.where(F.col("purl_text").isNotNull()).select("doc_id", "place", "purl_text")
        dead = lost.where("NOT again").select("doc_id", "place")
        live = materialize(live.join(dead.hint("merge"), ["doc_id", "place"], "left_anti"))
        asking = materialize(lost.where("again").select("doc_id", "place", "reference"))
        settled = rows.where("purl_text IS NOT NULL OR NOT again")


def _followed(rows: DataFrame) -> DataFrame:
    """Pointers followed to their ends; a row takes what its target has, and then the target's target."""
    while not rows.where(F.col("target").isNotNull()).isEmpty():
        at = rows.select("doc_id", F.col("place").alias("target"), F.col("purl_text").alias("__purl"), F.col("target").alias("__target"), F.col("again").alias("__again"))
        open_ = rows.where(F.col("target").isNotNull()).join(at.hint("merge"), ["doc_id", "target"], "left").select(
            "doc_id", "place", "reference", F.col("__purl").alias("purl_text"), F.col("__target").alias("target"),
            (F.col("again") | F.coalesce("__again", F.lit(False))).alias("again"))
        rows = materialize(rows.where(F.col("target").isNull()).unionByName(open_))
    return rows


def _usable(regs: DataFrame) -> DataFrame:
    return regs.withColumn("product_id", strip_space(F.col("product_id"))).withColumn(
        "purl_text", strip_space(F.col("purl_text"))).where(
        (F.coalesce("product_id", F.lit("")) != "") & (F.coalesce("purl_text", F.lit("")) != ""))


def csaf_statements(docs: DataFrame) -> DataFrame:
    """One statement per (cve, status, product id); the first flag naming the id justifies it."""
    vulns = docs.select("doc_id", F.posexplode(F.from_json("content", CSAF)["vulnerabilities"]).alias("vpos", "v"))
    flags = vulns.select("doc_id", "vpos", F.posexplode("v.flags").alias("fpos", "f")).select(
        "doc_id", "vpos", "fpos", F.col("f.label").alias("label"), F.explode("f.product_ids").alias("product_id"),
    ).groupBy("doc_id", "vpos", "product_id").agg(F.min_by("label", "fpos").alias("justification"))
    listed = vulns.select("doc_id", "vpos", F.col("v.cve").alias("vulnerability"), F.explode("v.product_status").alias("status", "ids")).select(
        "doc_id", "vpos", "vulnerability", "status", F.explode("ids").alias("product_id"))
    joined = listed.join(csaf_products(docs).hint("merge"), ["doc_id", "product_id"], "left").join(
        flags.hint("merge"), ["doc_id", "vpos", "product_id"], "left")
    purl = F.coalesce("purl_text", F.when(F.col("product_id").startswith("pkg:"), strip_space(F.col("product_id"))))
    return joined.withColumn("purl", purl).where(F.col("purl").isNotNull()).select(
        "doc_id", "vulnerability", F.array("purl").alias("products"), "product_id", "platform", "status",
        "justification", F.coalesce("indirect", F.lit(False)).alias("indirect"))


def load_vex(docs: DataFrame) -> DataFrame:
    """Statements of mixed documents, routed by their keys; `unrecognized` has the rest."""
    marked = docs.withColumn("__format", vex_format(F.col("content")))
    return (
        openvex_statements(marked.where(F.col("__format") == "openvex"))
        .unionByName(cyclonedx_statements(marked.where(F.col("__format") == "cyclonedx")))
        .unionByName(csaf_statements(marked.where(F.col("__format") == "csaf")))
    )


def unrecognized(docs: DataFrame) -> DataFrame:
    """(doc_id, reason): documents that `load_vex` cannot route."""
    known = vex_format(F.col("content")) != "unrecognized"
    return docs.where(~F.coalesce(known, F.lit(False))).select("doc_id", F.lit("no known VEX document").alias("reason"))


def verifier_statements(docs: DataFrame) -> DataFrame:
    """Rows for evidence verification, one per product: a native list or OpenVEX."""
    native = docs.select("doc_id", F.from_json("content", NATIVE).alias("d")).where(F.col("d.format").isNotNull()).select(
        "doc_id", F.explode("d.statements").alias("s")).select(
        "doc_id", F.col("s.cve").alias("vulnerability"), F.col("s.purl").alias("product_purl"), F.col("s.status").alias("status"),
        F.col("s.justification").alias("justification"))
    open_docs = docs.where(F.get_json_object("content", "$.format").isNull())
    s = open_docs.select("doc_id", F.explode(F.from_json("content", OPENVEX)["statements"]).alias("s"))
    return native.unionByName(s.select(
        "doc_id", F.coalesce(blank_to_null(F.col("s.vulnerability.name")), F.col("s.vulnerability.`@id`")).alias("vulnerability"),
        F.explode(F.array_distinct(F.flatten(F.transform("s.products", _product_texts)))).alias("product_purl"),
        F.lower(strip_space(F.col("s.status"))).alias("status"), F.col("s.justification").alias("justification")))
