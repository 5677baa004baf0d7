"""Queries of binary inventories and the readers of corpus files."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwright.operators import metrics as M
from clearwright.plans import sqltext as Q
from clearwright.plans import views as W
from clearwright.plans.decisions import decisions
from clearwright.plans.metrics import _SUMMARIES, summaries
from clearwright.plans.registry import query
from clearwright.sinks import tables as TB
from clearwright.sources import binaries as B
from clearwright.sources import corpus as C
from clearwright.operators.decide import decision_records

def part_sections(spark, sf):
    """Every part as the parsed sections of a binary that exports its name; each fifth could not be parsed."""
    broken, name = F.col("p_partkey") % 5 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))
    symbol = F.struct(F.concat(F.lit("_"), name).alias("name"), F.lit(1).alias("bind"), F.lit(2).alias("kind"), F.lit(True).alias("defined"), F.lit(None).cast("string").alias("version"))
    strings = F.encode(F.concat(F.lit("constant text\0short\0"), F.col("p_type"), F.lit("\0constant text\0")), "UTF-8")
    columns = [
        F.concat(F.lit("usr/lib/"), F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_name", 256).alias("sha256"),
        F.when(~broken, F.when(F.col("p_size") % 2 == 0, 62).otherwise(77)).alias("machine"), (~broken & (F.col("p_size") % 3 == 0)).alias("has_symtab"),
        (~broken & (F.col("p_size") % 4 == 0)).alias("has_interp"),
        F.when(~broken & (F.col("p_size") % 7 != 0), F.array(F.lit("libm.so.6"), F.lit("libc.so.6"))).otherwise(F.array().cast("array<string>")).alias("needed"),
        F.lit(None).cast("binary").alias("note"), F.when(~broken, strings).alias("rodata"),
        F.when(~broken, F.array(symbol)).otherwise(F.array().cast("array<struct<name:string,bind:int,kind:int,defined:boolean,version:string>>")).alias("dyn_syms"),
        F.array().cast("array<struct<name:string,bind:int,kind:int,defined:boolean,version:string>>").alias("symtab"),
        F.when(broken, "elf_parse: short").alias("warning"),
    ]
    return W.table(spark, sf, "part").select(*columns)


@query("i03_inventory_facts", """
SELECT 'usr/lib/' || CAST(p_partkey AS VARCHAR) AS path, CASE WHEN ok THEN CASE WHEN p_size % 2 = 0 THEN 'amd64' ELSE '77' END END AS arch, ok AS parsed,
  CASE WHEN ok THEN p_size % 3 <> 0 END AS stripped, CASE WHEN ok THEN p_size % 4 <> 0 AND p_size % 7 = 0 END AS static_linked,
  CASE WHEN ok THEN replace(p_name, ' ', '_') END AS symbol, CASE WHEN ok THEN 'GLOBAL' END AS bind, CASE WHEN ok THEN 'FUNC' END AS type,
  CASE WHEN ok THEN CASE WHEN p_size % 7 <> 0 THEN 'libc.so.6,libm.so.6' ELSE '' END END AS needed
FROM (SELECT *, p_partkey % 5 <> 0 AS ok FROM part)""")
def _(spark, sf):
    first = F.try_element_at("dyn_syms", F.lit(1))
    return B.inventory_facts(part_sections(spark, sf)).select(
        "path", "arch", F.col("warning").isNull().alias("parsed"), "stripped", "static_linked",
        first["normalized"].alias("symbol"), first["bind"].alias("bind"), first["type"].alias("type"), F.array_join("needed", ",").alias("needed"))


@query("o06_string_rows", """
SELECT 'usr/lib/' || CAST(p_partkey AS VARCHAR) AS path, position, value FROM part,
  (SELECT 0 AS position UNION ALL SELECT 1), LATERAL (SELECT CASE position WHEN 0 THEN 'constant text' ELSE p_type END AS value)
WHERE p_partkey % 5 <> 0 AND length(value) >= 6""")
def _(spark, sf):
    return B.string_rows(part_sections(spark, sf))


def document_files(spark, sf):
    """Every document as a file; some start with a binary magic."""
    head = F.element_at(F.array(*[F.lit(x) for x in ("7F454C46", "4D5A", "CFFAEDFE", "23212F")]), (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.concat(F.unhex(head), F.encode("text", "UTF-8"))
    return W.table(spark, sf, "documents").select(
        F.concat(F.lit("Bin/"), F.col("doc_id").cast("string")).alias("path"), content.alias("content")).withColumn("length", F.length("content").cast("bigint"))


@query("i01_file_inventory", """
SELECT 'Bin/' || CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 4 WHEN 0 THEN 'ELF' WHEN 1 THEN 'PE' ELSE 'MachO' END AS format,
  sha256(unhex(CASE doc_id % 4 WHEN 0 THEN '7F454C46' WHEN 1 THEN '4D5A' ELSE 'CFFAEDFE' END) || encode(text)) AS sha256
FROM documents WHERE doc_id % 4 <> 3""")
def _(spark, sf):
    return B.file_inventory(document_files(spark, sf)).drop("length")


@query("s22_binary_files", "SELECT 'Bin/' || CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 4 <> 3")
def _(spark, sf):
    return B.binaries(document_files(spark, sf)).select("path")


@query("o05_inventories_by_path", Q.select([W.INVENTORIES], """
SELECT artifact_id, path, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY lower(path)) AS INTEGER) AS position FROM inventories"""))
def _(spark, sf):
    return B.positions_by_path(W.inventories(spark, sf))


# ----------------------------------------------------------- corpus readers

_MANIFEST_DOC = """to_json(named_struct('component', named_struct('name', replace(p_name, ' ', '-'), 'ecosystem', 'native', 'provenance_status', if(p_size % 2 = 0, 'verified', ''),
  'purls', array(concat('pkg:generic/', replace(p_name, ' ', '-')), 'pkg:deb/debian/x'), 'identity_symbols', array('sym_a', p_brand), 'identity_strings', array('zlib [0-9]+')),
  'entries', array(
    named_struct('cve', concat('cve-2024-', p_partkey), 'affected_versions', array('<1'), 'manifest_version', '1', 'vulnerable_symbols', array(named_struct('name', 'inflate', 'confidence', 'definitive', 'dynsym_export_verified', true))),
    named_struct('cve', concat('CVE-2024-', p_partkey), 'affected_versions', array('<1'), 'manifest_version', '1', 'vulnerable_symbols', array(named_struct('name', 'later', 'confidence', 'probable', 'dynsym_export_verified', false))))))"""


def manifest_rows(spark, sf):
    docs = W.table(spark, sf, "part").select(F.concat(F.lit("components/"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("doc_id"), F.expr(_MANIFEST_DOC).alias("content"))
    return C.manifest_documents(docs)


@query("s14_manifest_documents", """
SELECT replace(p_name, ' ', '-') AS component, 'components/' || CAST(p_partkey AS VARCHAR) || '.json' AS source_file, CASE WHEN p_size % 2 = 0 THEN 'verified' ELSE 'unverified' END AS provenance_status FROM part""")
def _(spark, sf):
    return C.manifest_tables(manifest_rows(spark, sf))["components"].select("component", "source_file", "provenance_status")


@query("s14_manifest_first_entries", """
SELECT replace(p_name, ' ', '-') AS component, 'CVE-2024-' || CAST(p_partkey AS VARCHAR) AS cve, 'inflate' AS symbol, 'definitive' AS confidence FROM part""")
def _(spark, sf):
    return C.manifest_tables(manifest_rows(spark, sf))["entry_symbols"].select("component", "cve", "symbol", "confidence")


@query("s15_alias_documents", """
SELECT lower(p_brand) AS source_name, 'pkg:generic/' || replace(p_name, ' ', '-') AS component, CASE WHEN p_size % 2 = 0 THEN 'definitive' ELSE 'probable' END AS status FROM part""")
def _(spark, sf):
    body = """to_json(named_struct('aliases', array(named_struct('source_name', lower(p_brand), 'component', concat('pkg:generic/', replace(p_name, ' ', '-')), 'status', if(p_size % 2 = 0, 'definitive', 'probable')))))"""
    docs = W.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.expr(body).alias("content"))
    return C.alias_rows(docs).select("source_name", "component", "status")


@query("s16_catalogue_documents", Q.select([W.ARTIFACTS], "SELECT artifact_id, class, sha256, source_url, status FROM artifacts"))
def _(spark, sf):
    body = F.to_json(F.struct(F.array(F.struct(F.col("artifact_id").alias("id"), "class", "sha256", "source_url", "status")).alias("artifacts")))
    docs = W.artifacts(spark, sf).select(F.col("artifact_id").alias("doc_id"), body.alias("content"))
    return C.catalogue_rows(docs).select("artifact_id", "class", "sha256", "source_url", "status")


@query("s17_decision_lines", Q.select(Q.DECISIONS, """
SELECT artifact_id, cve, component_purl, verdict, reason_code FROM decisions"""))
def _(spark, sf):
    lines = decision_records(decisions(spark, sf)).select("artifact_id", F.to_json(F.struct(
        "cve", "component_purl", "verdict", "rule_id", "reason_code", "justification", "component", "statement_id", "evidence_bundle")).alias("value"))
    return lines.select("artifact_id", F.from_json("value", C.DECISION).alias("r")).select(
        "artifact_id", "r.cve", "r.component_purl", "r.verdict", "r.reason_code")


@query("s18_summary_documents", Q.select([*Q.DECISIONS, _SUMMARIES], """
SELECT artifact_id, cves_in, refused, coverage_percent FROM summaries WHERE length(artifact_id) <> 4"""))
def _(spark, sf):
    doc = F.when(F.length("artifact_id") == 4, "{broken").otherwise(F.to_json(F.struct("*")))
    docs = summaries(spark, sf).select(F.col("artifact_id").alias("doc_id"), doc.alias("content"))
    return C.summary_rows(docs).select("artifact_id", "cves_in", "refused", "coverage_percent")


def _broken_query(name, kind, body):
    """Documents of a kind, each fourth cut short: the reader gets the whole ones, the quarantine the rest."""
    @query(name, "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'not a JSON object of this kind' AS reason FROM part WHERE p_partkey % 4 = 1")
    def _(spark, sf):
        content = F.expr(f"CASE WHEN p_partkey % 4 = 1 THEN substr({body}, 1, 12) ELSE {body} END")
        return C.broken(W.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), content.alias("content")), kind)


_broken_query("s15_broken_alias_documents", "aliases", "to_json(named_struct('aliases', array(named_struct('source_name', p_brand, 'component', p_name))))")
_broken_query("s16_broken_catalogue_documents", "catalogue", "to_json(named_struct('artifacts', array(named_struct('id', p_brand, 'class', p_type))))")
_broken_query("s18_broken_summary_documents", "summary", "to_json(named_struct('cves_in', p_size, 'success', true))")
_broken_query("s25_broken_label_documents", "labels", "to_json(named_struct('statements', array(named_struct('id', p_brand, 'human_label', 'AFFECTED'))))")


@query("s21_checksum_lines", """
SELECT CASE WHEN doc_id % 7 <> 3 THEN sha256(text) END AS sha256, CASE WHEN doc_id % 7 <> 3 THEN 'bin/' || CAST(doc_id AS VARCHAR) END AS path, doc_id % 7 = 3 AS malformed
FROM documents WHERE doc_id % 7 <> 5""")
def _(spark, sf):
    n = F.col("doc_id")
    line = F.when(n % 7 == 3, F.sha2("text", 256)).when(n % 7 == 5, "# comment").otherwise(
        F.concat(F.sha2("text", 256), F.lit("  bin/"), n.cast("string"), F.lit(" ")))
    return C.checksum_lines(W.table(spark, sf, "documents").select(line.alias("value")))


@query("s25_label_documents", """
SELECT 'real-' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'NOT_AFFECTED' ELSE 'AFFECTED' END AS human_label FROM labels""")
def _(spark, sf):
    body = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("real-"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("quality") == 1, "NOT_AFFECTED").otherwise("AFFECTED").alias("human_label"))).alias("statements")))
    docs = W.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), body.alias("content"))
    return C.label_rows(docs).select("id", "human_label")


@query("k01_decision_line_text", Q.select(Q.DECISIONS, """
SELECT artifact_id, '{' || array_to_string(list_filter([
  '"cve":' || to_json(cve), '"component_purl":' || to_json(component_purl), '"verdict":' || to_json(verdict), '"rule_id":' || to_json(rule_id),
  '"reason_code":' || to_json(reason_code), '"justification":' || to_json(justification), '"component":' || to_json(component), '"statement_id":' || to_json(statement_id),
  CASE WHEN has_slice THEN '"evidence_bundle":' || to_json('evidence/' || artifact_id || '/statements/' || statement_id) END], lambda x: x IS NOT NULL), ',') || '}' AS line
FROM decisions"""))
def _(spark, sf):
    return TB.decision_lines(decision_records(decisions(spark, sf)))


_ROLLED = "SELECT '{0}' AS level, '{{' || array_to_string(list_filter([{1}], lambda x: x IS NOT NULL), ',') || '}}' AS document FROM ({2})"
_TOTALS = """count(*) AS artifacts, CAST(sum(cves_in) AS BIGINT) AS cves_in, CAST(sum(not_affected) AS BIGINT) AS not_affected, CAST(sum(affected) AS BIGINT) AS affected,
  CAST(sum(refused) AS BIGINT) AS refused FROM summaries JOIN artifacts USING (artifact_id)"""


def _rolled(level: str, keys: str) -> str:
    fields = [*(f"""'"{k}":' || to_json({k})""" for k in ("class", "artifact_id") if k in keys),
              *(f"""'"{k}":' || {k}""" for k in ("artifacts", "cves_in", "not_affected", "affected", "refused")),
              """'"decided":' || (not_affected + affected)""",
              """'"coverage_percent":' || coalesce((100 * (not_affected + affected)) // nullif(cves_in, 0), 0)"""]
    return _ROLLED.format(level, ", ".join(fields), f"SELECT {keys}{', ' if keys else ''}{_TOTALS}{' GROUP BY ' + keys if keys else ''}")


@query("k08_aggregate_documents", Q.select(
    [*Q.DECISIONS, _SUMMARIES, W.ARTIFACTS], "\nUNION ALL ".join((_rolled("total", ""), _rolled("class", "class"), _rolled("artifact", "class, artifact_id")))))
def _(spark, sf):
    rolled = M.coverage_rollup(M.with_class(summaries(spark, sf), W.artifacts(spark, sf)))
    return TB.aggregate_document(rolled)


@query("k11_binary_profile_rows", Q.select([W.INVENTORIES, W.ARTIFACTS], """
SELECT i.artifact_id, a.class, count(*) AS binaries, count(*) FILTER (WHERE stripped) AS stripped FROM inventories i JOIN artifacts a USING (artifact_id) GROUP BY 1, 2"""))
def _(spark, sf):
    profile = M.binary_profile(M.with_class(W.inventories(spark, sf), W.artifacts(spark, sf)), ["artifact_id", "class"])
    return profile.select("artifact_id", "class", "binaries", "stripped")


@query("u02_definitive_and_observed", Q.select([W.LINE_PARTS, W.COMPONENTS, W.ENTRIES, W.BENCHMARK_WORDS, W.ENTRY_SYMBOLS, W.INVENTORIES, W.SYMBOLS], """
SELECT symbol FROM entry_symbols WHERE confidence = 'definitive' INTERSECT SELECT normalized FROM symbols"""))
def _(spark, sf):
    listed = W.entry_symbols(spark, sf).where(F.col("confidence") == "definitive").select("symbol")
    return listed.intersect(W.symbols(spark, sf).select(F.col("normalized").alias("symbol")))
