"""The domain relations as views over the driver tables.

Each relation is given twice: as a DataFrame for Spark and as a SQL common table
expression for the check engine.  `FIXTURES.md` lists what stands in for what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwright.functions import symbols as sym
from clearwright.operators.factors import joined
from clearwright.operators.tables import materialize, once

CLASSES = ("firmware", "oci-app", "oci-base", "static-binary", "substitute-container")
BUCKETS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(n: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def _number(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+)$", 1).cast("int")


def _padded(n: Column) -> Column:
    text = n.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 4 - F.length(text))), text)


def name_code(name: Column) -> Column:
    """Small number fixed by a name; drives the rules that vary by component."""
    return F.length(name) * 7 + F.ascii(name) + F.ascii(F.right(name, F.lit(1))) + F.ascii(F.substring(name, 3, 1))


NAME_CODE_SQL = "(length({0})*7 + ascii({0}) + ascii(right({0},1)) + ascii(substr({0},3,1)))"


def code_sql(column: str) -> str:
    return NAME_CODE_SQL.format(column)


# ---------------------------------------------------------------- artifacts

def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("artifact_id")).distinct()
    n = _number(F.col("artifact_id"))
    return d.select(
        "artifact_id",
        _pick(n % 5, CLASSES).alias("class"),
        F.when(n % 6 != 0, F.sha2(F.col("artifact_id"), 256)).alias("sha256"),
        F.when(n % 4 == 3, "absent").otherwise("present").alias("status"),
        F.when(n % 7 != 0, F.concat(F.lit("https://example.org/a/"), F.col("artifact_id"))).alias("source_url"),
    )


ARTIFACTS = """artifacts AS (
  SELECT artifact_id,
    ['firmware','oci-app','oci-base','static-binary','substitute-container'][(n % 5) + 1] AS class,
    CASE WHEN n % 6 <> 0 THEN sha256(artifact_id) END AS sha256,
    CASE WHEN n % 4 = 3 THEN 'absent' ELSE 'present' END AS status,
    CASE WHEN n % 7 <> 0 THEN 'https://example.org/a/' || artifact_id END AS source_url
  FROM (SELECT DISTINCT source AS artifact_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n
        FROM documents))"""

# ----------------------------------------------------------------- findings

_NAME = "replace(p_name, ' ', '-')"
_BRAND = "lower(replace(p_brand, '#', ''))"
_VERSION = "'1.' || CAST(p_size AS VARCHAR(20)) || '.0'"

# The same text runs on both engines.
FINDING_PURL = f"""CASE l_linenumber % 7
  WHEN 1 THEN 'pkg:deb/debian/lib' || {_NAME} || '@1:' || {_VERSION} || '-' || CAST(l_linenumber AS VARCHAR(20)) || '?arch=amd64&upstream=' || {_BRAND}
  WHEN 2 THEN 'pkg:deb/debian/' || {_NAME} || '@' || {_VERSION} || '%2Bdfsg-1?upstream=' || {_BRAND} || '%40' || {_VERSION}
  WHEN 3 THEN 'pkg:rpm/redhat/' || {_NAME} || '@' || {_VERSION} || '-3.fc40?upstream=' || {_BRAND} || '-' || {_VERSION} || '-3.fc40.src.rpm'
  WHEN 4 THEN 'pkg:apk/alpine/' || {_NAME} || '@' || {_VERSION} || '-r' || CAST(l_suppkey % 10 AS VARCHAR(20)) || '?upstream=' || {_BRAND}
  WHEN 5 THEN 'pkg:npm/%40acme/' || upper({_NAME}) || '@' || {_VERSION}
  WHEN 6 THEN 'pkg:generic/' || {_NAME} || '@' || {_VERSION}
  ELSE CASE p_size % 10
    WHEN 0 THEN 'pkg:deb/debian/' || {_NAME} || '-doc@' || {_VERSION} || '-1'
    WHEN 1 THEN {_NAME}
    WHEN 2 THEN 'pkg:generic/' || {_NAME}
    WHEN 3 THEN 'pkg:deb/debian/lib' || {_NAME} || '@%25?upstream=' || {_BRAND}
    ELSE 'pkg:generic/' || {_NAME} || '@' || {_VERSION} || '?checksum=sha256:' || CAST(p_size AS VARCHAR(20)) || '&Arch=x86_64'
  END
END"""


def _line_parts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity"
    )
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey)


def _cve() -> Column:
    return F.concat(F.lit("CVE-"), F.year("l_shipdate").cast("string"), F.lit("-"), _padded(F.col("l_suppkey")))


CVE_SQL = """'CVE-' || CAST(year(l_shipdate) AS VARCHAR) || '-' ||
  repeat('0', greatest(0, 4 - length(CAST(l_suppkey AS VARCHAR)))) || CAST(l_suppkey AS VARCHAR)"""


def raw_findings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per scanner hit, ids and PURLs as a scanner would print them."""
    hit = F.struct(
        F.concat(F.lit("src"), (F.col("l_suppkey") % 20).cast("string")).alias("artifact_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.lower(_cve()))).otherwise(_cve()).alias("cve"),
        F.expr(FINDING_PURL).alias("component_purl"),
    )
    # Generator output, so that later filters do not rebuild these texts.
    return _line_parts(spark, sf).select(F.col("l_orderkey").alias("scan_id"), F.inline(F.array(hit)))


LINE_PARTS = """line_parts AS (
  SELECT l_orderkey, l_suppkey, l_linenumber, l_shipdate, l_quantity, p_partkey, p_name, p_brand, p_size, p_type
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

RAW_FINDINGS = f"""{LINE_PARTS},
raw_findings AS (
  SELECT l_orderkey AS scan_id, 'src' || CAST(l_suppkey % 20 AS VARCHAR) AS artifact_id,
    CASE WHEN l_linenumber % 2 = 0 THEN ' ' || lower({CVE_SQL}) ELSE {CVE_SQL} END AS cve,
    {FINDING_PURL} AS component_purl
  FROM line_parts)"""

FINDINGS = f"""{RAW_FINDINGS},
findings AS (
  SELECT DISTINCT artifact_id, upper(trim(cve)) AS cve, trim(component_purl) AS component_purl
  FROM raw_findings WHERE trim(cve) <> '' AND trim(component_purl) <> '')"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    from clearwright.operators.decide import normalize_findings

    return normalize_findings(raw_findings(spark, sf))


# ------------------------------------------------------- curated dimensions

def components(spark: SparkSession, sf: str) -> DataFrame:
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    c = F.col("code")
    return (
        table(spark, sf, "part").select(name.alias("component")).distinct()
        .withColumn("code", name_code(F.col("component")))
        .where(c % 4 != 3)
        .select(
            "component", "code",
            F.lit("native").alias("ecosystem"),
            F.concat(F.lit("components/native/"), F.col("component"), F.lit(".json")).alias("source_file"),
            F.when(c % 5 == 0, "unverified").otherwise("verified").alias("provenance_status"),
            (c % BUCKETS).alias("bucket"),
        )
    )


COMPONENTS = f"""components AS (
  SELECT component, code, 'native' AS ecosystem, 'components/native/' || component || '.json' AS source_file,
    CASE WHEN code % 5 = 0 THEN 'unverified' ELSE 'verified' END AS provenance_status, code % {BUCKETS} AS bucket
  FROM (SELECT component, {code_sql('component')} AS code
        FROM (SELECT DISTINCT replace(p_name, ' ', '-') AS component FROM part))
  WHERE code % 4 <> 3)"""


def component_purls(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("code")
    base = F.concat(F.lit("pkg:generic/"), F.col("component"))
    first = (
        F.when(c % 3 == 0, base)
        .when(c % 3 == 1, F.concat(base, F.lit("@1.10.0")))
        .otherwise(F.concat(base, F.lit("@1."), (c % 50 + 1).cast("string"), F.lit(".0")))
    )
    second = F.when(c % 2 == 0, F.concat(F.lit("pkg:deb/debian/"), F.col("component")))
    return (
        components(spark, sf)
        .select("component", "source_file", F.posexplode(F.array_compact(F.array(first, second))))
        .select("component", "source_file", F.col("pos").alias("purl_pos"), F.col("col").alias("purl_text"))
    )


COMPONENT_PURLS = f"""{COMPONENTS},
component_purls AS (
  SELECT component, source_file, 0 AS purl_pos, 'pkg:generic/' || component ||
    CASE code % 3 WHEN 0 THEN '' WHEN 1 THEN '@1.10.0' ELSE '@1.' || CAST(code % 50 + 1 AS VARCHAR) || '.0' END AS purl_text
  FROM components
  UNION ALL
  SELECT component, source_file, 1, 'pkg:deb/debian/' || component FROM components WHERE code % 2 = 0)"""


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    source = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    n = F.col("n")
    return (
        table(spark, sf, "part")
        .select(source.alias("source_name"), name.alias("component"))
        .where(name_code(F.col("component")) % 4 != 3)
        .groupBy("source_name").agg(F.min("component").alias("component"))
        .withColumn("n", _number(F.col("source_name")))
        .where(n % 5 != 4)
        .select(
            "source_name",
            F.concat(F.lit("pkg:generic/"), F.col("component")).alias("component"),
            F.when(n % 3 == 0, "probable").otherwise("definitive").alias("status"),
        )
    )


ALIASES = f"""aliases AS (
  SELECT source_name, 'pkg:generic/' || component AS component,
    CASE WHEN n % 3 = 0 THEN 'probable' ELSE 'definitive' END AS status
  FROM (SELECT source_name, min(component) AS component,
               CAST(regexp_extract(source_name, '([0-9]+)$', 1) AS INTEGER) AS n
        FROM (SELECT lower(replace(p_brand, '#', '')) AS source_name, replace(p_name, ' ', '-') AS component FROM part)
        WHERE {code_sql('component')} % 4 <> 3 GROUP BY source_name)
  WHERE n % 5 <> 4)"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """(component, cve) pairs with a reviewed record; every third supplier's are probable only.

    Stored once: decisions and slices ask for them many times, and each would join all lines to their parts.
    """
    def build() -> DataFrame:
        name = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
        return (
            _line_parts(spark, sf)
            .where(F.col("l_suppkey") % 7 == 0)
            .select(name.alias("component"), _cve().alias("cve"),
                    (F.col("l_suppkey") % 21 == 0).alias("probable_only"),
                    (F.col("l_suppkey") % 2 == 0).alias("exported"))
            .where(name_code(F.col("component")) % 4 != 3)
            .distinct()
            .repartition(4 * spark.sparkContext.defaultParallelism, "component", "cve")  # few bytes, much work per row
        )

    return once(spark, "entries", [f"{sf}/lineitem.parquet", f"{sf}/part.parquet"], build)


ENTRIES = f"""entries AS (
  SELECT DISTINCT replace(p_name, ' ', '-') AS component, {CVE_SQL} AS cve,
    l_suppkey % 21 = 0 AS probable_only, l_suppkey % 2 = 0 AS exported
  FROM line_parts WHERE l_suppkey % 7 = 0 AND {code_sql("replace(p_name, ' ', '-')")} % 4 <> 3)"""


def _benchmark_words(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return table(spark, sf, "benchmark").select(
        (F.col("item_id") % BUCKETS).alias("bucket"), F.explode(words).alias("symbol")
    ).distinct()


BENCHMARK_WORDS = f"""benchmark_words AS (
  SELECT DISTINCT item_id % {BUCKETS} AS bucket, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS symbol
  FROM benchmark)"""


def identity_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Long words of a component's passages; position stands for list order."""
    words = _benchmark_words(spark, sf).where(F.length("symbol") >= 10)
    return (
        components(spark, sf).select("component", "bucket").join(words, "bucket")
        .select("component", "symbol", F.length("symbol").alias("position"))
    )


IDENTITY_SYMBOLS = """identity_symbols AS (
  SELECT component, symbol, CAST(length(symbol) AS INTEGER) AS position
  FROM components JOIN benchmark_words USING (bucket) WHERE length(symbol) >= 10)"""


def entry_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Vulnerable symbols of every entry, one row per symbol.

    Entries are many and components few, so a short list of the components' words is broadcast: entries shuffled by component meet in few tasks.
    """
    words = _benchmark_words(spark, sf).where(F.length("symbol").between(8, 9))
    listed = materialize(
        components(spark, sf).select("component", "bucket").join(words, "bucket").select("component", "symbol")
    )
    # What is of the entry is written before its symbols join it, so that a search for some entries goes below the join.
    known = entries(spark, sf).select(
        "component", "cve", F.when(F.col("probable_only"), "probable").otherwise("definitive").alias("confidence"),
        F.col("exported").alias("dynsym_export_verified"))
    return joined(known, listed, listed.count(), "component").select(
        "component", "cve", "symbol", "confidence", "dynsym_export_verified")


ENTRY_SYMBOLS = """entry_symbols AS (
  SELECT component, cve, symbol, CASE WHEN probable_only THEN 'probable' ELSE 'definitive' END AS confidence,
    exported AS dynsym_export_verified
  FROM entries JOIN (SELECT component, symbol FROM components JOIN benchmark_words USING (bucket)
                     WHERE length(symbol) BETWEEN 8 AND 9) USING (component))"""


def identity_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Identity regexes: the word pairs that begin with a capital anywhere in a component's passages, in item order."""
    pairs = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"([A-Z][a-z]+ [a-z]+) "), F.lit(1)))
    b = table(spark, sf, "benchmark").select(
        (F.col("item_id") % BUCKETS).alias("bucket"), F.col("item_id").alias("position"), F.explode(pairs).alias("pair"))
    return components(spark, sf).join(b, "bucket").select(
        "component", "position", F.concat(F.col("pair"), F.lit("[ ,.]")).alias("pattern")
    )


IDENTITY_STRINGS = f"""identity_strings AS (
  SELECT component, position, pair || '[ ,.]' AS pattern
  FROM components JOIN (SELECT DISTINCT item_id % {BUCKETS} AS bucket, item_id AS position,
      unnest(regexp_extract_all(text, '([A-Z][a-z]+ [a-z]+) ', 1)) AS pair FROM benchmark) USING (bucket))"""

# ------------------------------------------------------------- binary facts

_FACTS = """
  source AS artifact_id, 'bin/' || CAST(doc_id AS VARCHAR(20)) AS path,
  CASE WHEN source = 'src7' OR doc_id % 11 = 10 THEN 'unknown' ELSE 'ELF' END AS format,
  (doc_id % 3 = 0) AS stripped, (doc_id % 5 = 0) AS static_linked,
  NOT (doc_id % 3 = 0 AND doc_id % 4 = 1) AS named"""


def binaries(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, stored once in several files per core.

    A file of one row group is read by one task however large it is, and what is taken from the texts is far dearer than reading them.
    """
    def build() -> DataFrame:
        files = 4 * spark.sparkContext.defaultParallelism
        return table(spark, sf, "documents").select("doc_id", "source", "text").repartition(files, "doc_id")

    return once(spark, "binaries", [f"{sf}/documents.parquet"], build)


def inventories(spark: SparkSession, sf: str) -> DataFrame:
    """One document is one binary; stripped binaries keep only even-length words as dynamic symbols."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    d = binaries(spark, sf).selectExpr(*_split(_FACTS), "text")
    d = d.withColumn("words", F.when(F.col("named"), words).otherwise(F.array().cast("array<string>")))
    return d.select(
        "artifact_id", "path", F.sha2("text", 256).alias("sha256"), "format", "stripped", "static_linked",
        F.exists("words", lambda w: F.length(w) % 2 == 0).alias("has_dynamic"),
        (~F.col("stripped") & F.exists("words", lambda w: F.length(w) % 2 == 1)).alias("has_table"),
        sym.inventory_id(F.col("path"), F.lit("")).alias("inventory_id"),
    )


def _split(select: str) -> list[str]:
    out, depth, item = [], 0, ""
    for ch in select:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(item.strip())
            item = ""
        else:
            item += ch
    return [*out, item.strip()]


INVENTORY_WORDS = f"""inventory_words AS (
  SELECT {_FACTS}, text, regexp_extract_all(lower(text), '[a-z]+') AS words FROM documents)"""

INVENTORIES = f"""{INVENTORY_WORDS},
inventories AS (
  SELECT artifact_id, path, sha256(text) AS sha256, format, stripped, static_linked,
    named AND len(list_filter(words, lambda w: length(w) % 2 = 0)) > 0 AS has_dynamic,
    named AND NOT stripped AND len(list_filter(words, lambda w: length(w) % 2 = 1)) > 0 AS has_table,
    path AS inventory_id
  FROM inventory_words)"""


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Observed symbols per binary; names whose length divides by five carry a linker underscore."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    d = binaries(spark, sf).selectExpr(*_split(_FACTS), "text").where("named")
    w = F.col("w")
    return (
        d.select("artifact_id", F.col("path").alias("inventory_id"), "stripped", F.explode(words).alias("w"))
        .where(~F.col("stripped") | (F.length(w) % 2 == 0))
        .select(
            "artifact_id", "inventory_id",
            F.when(F.length(w) % 5 == 0, F.concat(F.lit("_"), w)).otherwise(w).alias("raw"),
            F.when(F.length(w) % 2 == 0, "dyn_syms").otherwise("symtab").alias("table_kind"),
            (F.length(w) % 3 != 0).alias("defined"),
        )
        .withColumn("normalized", sym.normalize(F.col("raw")))
    )


SYMBOLS = """symbols AS (
  SELECT artifact_id, inventory_id, CASE WHEN length(w) % 5 = 0 THEN '_' || w ELSE w END AS raw,
    CASE WHEN length(w) % 2 = 0 THEN 'dyn_syms' ELSE 'symtab' END AS table_kind, length(w) % 3 <> 0 AS defined,
    w AS normalized
  FROM (SELECT artifact_id, path AS inventory_id, stripped, unnest(list_distinct(words)) AS w
        FROM inventory_words WHERE named)
  WHERE NOT stripped OR length(w) % 2 = 0)"""


def ro_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Read-only strings per binary: the lines of the document."""
    return binaries(spark, sf).select(
        F.col("source").alias("artifact_id"),
        F.concat(F.lit("bin/"), F.col("doc_id").cast("string")).alias("inventory_id"),
        F.explode(F.split("text", "\n")).alias("value"),
    )


RO_STRINGS = """ro_strings AS (
  SELECT source AS artifact_id, 'bin/' || CAST(doc_id AS VARCHAR) AS inventory_id,
    unnest(string_split(text, chr(10))) AS value FROM documents)"""
