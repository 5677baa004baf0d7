"""VEX documents as ordered lines.

A document lists every statement of an artifact, and one artifact may hold a
third of all statements, so no document is built in one row.  Each emitter
returns lines keyed by (artifact_id, section, k1, k2, part, k3); `write_documents`
range-sorts them, and an artifact's files read in name order are its document.

Whether a line needs a comma depends on the line before it alone.  `separated` deals the lines to ranges of the document
order, looks at the line before within a range, and takes the last key of the ranges before for its first line, so
bodies move once, to their range, and no join touches them.  Emitters read `inputs` several times: give them a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearwright.functions import ids as I
from clearwright.functions import purl as P
from clearwright.functions import verdict as V
from clearwright.functions.text import strip_space
from clearwright.operators.factors import joined
from clearwright.operators.tables import stored

AUTHOR = "clearwright"
VERSION = "1"
ORDER = ("artifact_id", "section", "k1", "k2", "part", "k3")
KEYS_PER_RANGE = 64


def document_inputs(statements: DataFrame, bundles: DataFrame, hashes: DataFrame, version: str) -> DataFrame:
    """Statements with the bundle id, artifact hash, pinned PURL and fixed timestamp of their document.

    PURLs are parsed once per distinct text; lists of artifacts and PURLs come to the statements while they are short.
    """
    of_artifact = stored(bundles.join(hashes, "artifact_id"))
    purls = stored(P.with_purl(statements.select("component_purl").distinct(), "component_purl", "__purl").select("component_purl", "__purl"))
    placed = joined(statements, of_artifact, of_artifact.count(), "artifact_id")
    parsed = joined(placed, purls, purls.count(), "component_purl")
    cve = F.upper(strip_space(F.col("cve")))
    return parsed.withColumn("pinned", P.pinned_canonical(F.col("__purl"), F.col("artifact_sha256"))).select(
        "artifact_id", "bundle_id", "artifact_sha256", I.timestamp_from(F.col("bundle_id")).alias("timestamp"),
        cve.alias("cve"), "component_purl", "statement_id", "pinned", F.col("__purl.name").alias("name"),
        F.col("__purl.version").alias("version"), "verdict", "justification", "rule_id", "reason_code",
        F.lit(version).alias("manifest_version"),
        V.impact_detail(F.col("rule_id"), F.lit(version), F.col("bundle_id")).alias("detail"))


def _note(disclaimer: str | None) -> Column:
    """The caller's disclaimer; NULL fields do not appear in documents."""
    return F.lit(disclaimer).cast("string")


def _headers(inputs: DataFrame) -> DataFrame:
    """One row per document; partial aggregation keeps hot artifacts cheap."""
    return inputs.groupBy("artifact_id", "bundle_id", "artifact_sha256", "timestamp").agg(
        F.count(F.lit(1)).alias("n_statements"), F.count_if(F.col("verdict") == V.UNDER_INVESTIGATION).alias("n_refusals"))


def _seed(fmt: str) -> Column:
    return I.joined_digest(F.lit(fmt), F.col("bundle_id"), F.col("artifact_sha256"), F.col("timestamp"))


def _line(df: DataFrame, section: int, text: Column, k1: Column | None = None, k2: Column | None = None,
          part: int = 0, k3: Column | None = None, opens: str = "", leaves: str | None = None) -> DataFrame:
    """A line that is, or begins, an element of the list `opens`, or ends one of the list `leaves`."""
    blank = F.lit("")
    return df.select(
        "artifact_id", F.lit(section).alias("section"), (blank if k1 is None else k1).alias("k1"),
        (blank if k2 is None else k2).alias("k2"), F.lit(part).alias("part"), (blank if k3 is None else k3).alias("k3"),
        text.alias("line"), F.lit(opens).alias("opens"), F.lit(opens if leaves is None else leaves).alias("leaves"))


def _ranges(lines: DataFrame, count: int) -> Column:
    """The number of a line's range, 0 to count - 1, from a sample of keys of bounded size."""
    drawn = lines.select(*ORDER).orderBy(F.xxhash64(*ORDER), *ORDER).limit(count * KEYS_PER_RANGE).collect()
    keys = sorted(tuple(r) for r in drawn)
    bounds = sorted({keys[len(keys) * n // count] for n in range(1, count)}) if keys else []
    if not bounds:
        return F.lit(0)
    listed = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(ORDER, b))) for b in bounds))
    return F.size(F.filter(listed, lambda b: b <= F.struct(*ORDER)))


def separated(lines: DataFrame) -> DataFrame:
    """Lines in document order with a comma before every element that follows another of its list; range number in `range`."""
    count = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.withColumn("range", _ranges(lines, count))
    ends = dealt.groupBy("range").agg(F.max(F.struct(*ORDER, "leaves")).alias("end")).orderBy("range").collect()
    before = [x for a, b in zip(ends, ends[1:]) for x in (F.lit(b["range"]), F.concat_ws("\0", F.lit(a.end.artifact_id), F.lit(a.end.leaves)))]
    place = Window.partitionBy("range").orderBy(*ORDER)
    last = F.lag(F.concat_ws("\0", "artifact_id", "leaves")).over(place)
    if before:
        last = F.coalesce(last, F.element_at(F.create_map(*before), F.col("range")))
    follows = (F.col("opens") != "") & F.coalesce(last == F.concat_ws("\0", "artifact_id", "opens"), F.lit(False))
    ranged = dealt.repartitionByRange(count, "range")
    return ranged.withColumn("line", F.when(follows, F.concat(F.lit(","), "line")).otherwise(F.col("line"))).select(*ORDER, "line", "range")


def _opened(head: Column, rest: str) -> Column:
    """An object's JSON text left open, with `rest` appended."""
    text = F.to_json(head)
    return F.concat(F.left(text, F.length(text) - 1), F.lit(rest))


def openvex_lines(inputs: DataFrame, disclaimer: str | None = None) -> DataFrame:
    """OpenVEX lines; a disclaimer goes into `tooling`."""
    tooling = F.concat(F.lit(f"{AUTHOR} {VERSION} | "), _note(disclaimer))
    head = F.struct(
        F.lit("https://openvex.dev/ns/v0.2.0").alias("@context"), I.document_id("openvex", _seed("openvex")).alias("@id"),
        F.lit(AUTHOR).alias("author"), F.lit("document creator").alias("role"), F.col("timestamp"), F.lit(1).alias("version"), tooling.alias("tooling"))
    product = F.struct(
        F.col("pinned").alias("@id"), F.struct(F.col("pinned").alias("purl")).alias("identifiers"),
        F.struct(F.col("artifact_sha256").alias("sha-256")).alias("hashes"))
    action = F.when(F.col("verdict") == V.AFFECTED, F.concat(
        F.lit("Vulnerable code observed in scanned artifact per "), F.col("rule_id"), F.lit(".")))
    body = F.to_json(F.struct(
        F.struct(F.col("cve").alias("name")).alias("vulnerability"), F.array(product).alias("products"),
        V.status_of(F.col("verdict"), V.OPENVEX_STATUS).alias("status"),
        F.when(F.col("verdict") == V.NOT_AFFECTED, F.col("justification")).alias("justification"),
        F.col("detail").alias("impact_statement"), action.alias("action_statement")))
    h = _headers(inputs)
    statements = _line(inputs, 1, body, F.col("cve"), F.col("component_purl"), opens="statements")
    return separated(_line(h, 0, _opened(head, ',"statements":[')).unionByName(statements).unionByName(_line(h, 9, F.lit("]}"))))


def cyclonedx_lines(inputs: DataFrame, disclaimer: str | None = None) -> DataFrame:
    """CycloneDX lines; a disclaimer is a metadata property."""
    tool = F.struct(F.lit(AUTHOR).alias("vendor"), F.lit(AUTHOR).alias("name"), F.lit(VERSION).alias("version"))
    said = F.when(_note(disclaimer).isNotNull(), F.array(F.struct(F.lit(f"{AUTHOR}:disclaimer").alias("name"), _note(disclaimer).alias("value"))))
    def digest() -> Column:
        return F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("artifact_sha256").alias("content")))

    top = F.struct(
        F.lit("cw:artifact").alias("bom-ref"), F.lit("application").alias("type"), F.lit("scanned-artifact").alias("name"),
        F.concat(F.lit("pkg:generic/artifact@0?checksum=sha256%3A"), F.col("artifact_sha256")).alias("purl"), digest().alias("hashes"))
    head = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), I.uuid_from(_seed("cyclonedx")).alias("serialNumber"),
        F.lit(1).alias("version"), F.struct(F.col("timestamp"), top.alias("component"), F.array(tool).alias("tools"), said.alias("properties")).alias("metadata"))
    ref = I.component_ref(F.col("pinned"))
    component = F.to_json(F.struct(
        ref.alias("bom-ref"), F.lit("library").alias("type"), "name", F.col("pinned").alias("purl"), digest().alias("hashes")))
    analysis = F.struct(
        V.status_of(F.col("verdict"), V.CYCLONEDX_STATE).alias("state"),
        F.when(F.col("verdict") == V.NOT_AFFECTED, V.cyclonedx_justification(F.col("justification"))).alias("justification"),
        "detail", F.col("timestamp").alias("firstIssued"), F.col("timestamp").alias("lastUpdated"))
    vulnerability = F.to_json(F.struct(
        F.col("cve").alias("id"), analysis.alias("analysis"), F.array(F.struct(ref.alias("ref"))).alias("affects")))
    h = _headers(inputs)
    components = inputs.select("artifact_id", "artifact_sha256", "pinned", "name").distinct()
    return separated(
        _line(h, 0, _opened(head, ',"components":['))
        .unionByName(_line(components, 1, component, ref, opens="components"))
        .unionByName(_line(h, 2, F.lit('],"vulnerabilities":[')))
        .unionByName(_line(inputs, 3, vulnerability, F.col("cve"), F.col("component_purl"), opens="vulnerabilities"))
        .unionByName(_line(h, 9, F.lit("]}")))
    )


def csaf_groups(inputs: DataFrame) -> DataFrame:
    """Statements by (cve, status): distinct product ids, threats and flags counted."""
    status = V.status_of(F.col("verdict"), V.CSAF_STATUS)
    rows = inputs.select("artifact_id", "cve", status.alias("status"), I.product_id(F.col("pinned")).alias("product_id"), "justification")
    per_product = rows.groupBy("artifact_id", "cve", "status", "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("justification").alias("flags"))
    return per_product.groupBy("artifact_id", "cve", "status").agg(
        F.count(F.lit(1)).alias("products"), F.sum("n").alias("threats"), F.sum("flags").alias("flags"))


def csaf_lines(inputs: DataFrame, disclaimer: str | None = None) -> DataFrame:
    """CSAF lines; a disclaimer is a note of the document."""
    notes = F.when(_note(disclaimer).isNotNull(), F.array(F.struct(F.lit("legal_disclaimer").alias("category"), _note(disclaimer).alias("text"))))
    publisher = F.struct(F.lit("vendor").alias("category"), F.lit(AUTHOR).alias("name"), F.lit("https://example.org/clearwright").alias("namespace"))
    revision = F.struct(F.lit("1").alias("number"), F.col("timestamp").alias("date"), F.lit("Initial version.").alias("summary"))
    tracking = F.struct(
        I.tracking_id(_seed("csaf")).alias("id"), F.lit("1").alias("version"), F.lit("final").alias("status"),
        F.col("timestamp").alias("initial_release_date"), F.col("timestamp").alias("current_release_date"),
        F.array(revision).alias("revision_history"))
    head = F.struct(F.struct(
        F.lit("csaf_vex").alias("category"), F.lit("2.0").alias("csaf_version"), F.lit("VEX").alias("title"),
        publisher.alias("publisher"), tracking.alias("tracking"), notes.alias("notes")).alias("document"))
    pid = I.product_id(F.col("pinned"))
    release = F.when(F.col("version") == "", "0").otherwise(F.col("version"))
    product = F.struct(
        F.concat_ws(" ", F.col("name"), release).alias("name"), pid.alias("product_id"),
        F.struct(F.col("pinned").alias("purl")).alias("product_identification_helper"))
    version = F.struct(F.lit("product_version").alias("category"), release.alias("name"), product.alias("product"))
    name = F.struct(F.lit("product_name").alias("category"), F.col("name").alias("name"), F.array(version).alias("branches"))
    branch = F.to_json(F.struct(F.lit("vendor").alias("category"), F.lit(AUTHOR).alias("name"), F.array(name).alias("branches")))

    status = V.status_of(F.col("verdict"), V.CSAF_STATUS)
    rows = inputs.withColumn("status", status).withColumn("product_id", pid)
    groups = rows.groupBy("artifact_id", "cve", "status").agg(F.count("justification").alias("flags"))

    def each(df: DataFrame, part: int, text: Column, k3: Column | None = None, **lists: str) -> DataFrame:
        return _line(df, 3, text, F.col("cve"), F.col("status"), part, k3, **lists)

    # A vulnerability's first line opens an element and its last line leaves it; the lists in it are apart by other lines.
    opened = each(groups, 0, F.concat(
        _opened(F.struct("cve"), ',"product_status":{"'), F.col("status"), F.lit('":[')), opens="vulnerabilities", leaves="")
    ids = rows.select("artifact_id", "cve", "status", "product_id").distinct()
    flag = F.to_json(F.struct(F.col("justification").alias("label"), F.array("product_id").alias("product_ids")))
    threat = F.to_json(F.struct(
        F.lit("impact").alias("category"), F.col("detail").alias("details"), F.array("product_id").alias("product_ids")))
    flagged = rows.where((F.col("verdict") == V.NOT_AFFECTED) & F.col("justification").isNotNull())
    h = _headers(inputs)
    return separated(
        _line(h, 0, _opened(head, ',"product_tree":{"branches":['))
        .unionByName(_line(inputs.select("artifact_id", "pinned", "name", "version").distinct(), 1, branch, pid, opens="branches"))
        .unionByName(_line(h, 2, F.lit(']},"vulnerabilities":[')))
        .unionByName(opened)
        .unionByName(each(ids, 1, F.concat(F.lit('"'), F.col("product_id"), F.lit('"')), F.col("product_id"), opens="ids"))
        .unionByName(each(groups, 2, F.when(F.col("flags") > 0, ']},"flags":[').otherwise(']}')))
        .unionByName(each(flagged, 3, flag, F.col("component_purl"), opens="flags"))
        .unionByName(each(groups, 4, F.when(F.col("flags") > 0, '],"threats":[').otherwise(',"threats":[')))
        .unionByName(each(rows, 5, threat, F.col("component_purl"), opens="threats"))
        .unionByName(each(groups, 6, F.lit("]}"), leaves="vulnerabilities"))
        .unionByName(_line(h, 9, F.lit("]}")))
    )


def refusal_lines(inputs: DataFrame, disclaimer: str | None = None) -> DataFrame:
    """Refused statements only; a document without refusals has an empty list."""
    head = F.struct(F.lit("refusals-v1").alias("format"), "bundle_id", F.col("n_refusals").alias("count"), _note(disclaimer).alias("disclaimer"))
    refused = inputs.where(F.col("verdict") == V.UNDER_INVESTIGATION)
    body = F.to_json(F.struct(
        "statement_id", "cve", F.col("pinned").alias("component_purl"), "reason_code", "rule_id", "manifest_version", "bundle_id", "detail"))
    h = _headers(inputs)
    return separated(
        _line(h, 0, _opened(head, ',"refusals":['))
        .unionByName(_line(refused, 1, body, F.col("cve"), F.col("component_purl"), opens="refusals"))
        .unionByName(_line(h, 9, F.lit("]}")))
    )


def emission_summary(inputs: DataFrame) -> DataFrame:
    verdict = F.col("verdict")
    return inputs.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(verdict == V.NOT_AFFECTED).alias("cleared"),
        F.count_if(verdict == V.AFFECTED).alias("affected"), F.count_if(verdict == V.UNDER_INVESTIGATION).alias("refusals"))


def write_documents(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write line files per artifact; their concatenation in name order is the document.

    Lines of an emitter are dealt by ranges of the document order already, so they are sorted where they lie.
    """
    ordered = lines.sortWithinPartitions(*ORDER)
    ordered.select("artifact_id", "line").write.mode(mode).partitionBy("artifact_id").text(path)
