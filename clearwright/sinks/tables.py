"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_decisions(records: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Decision records, one folder per artifact; NULL fields are left out of JSON lines."""
    records.write.mode(mode).partitionBy("artifact_id").format(fmt).save(path)


def decision_lines(records: DataFrame) -> DataFrame:
    """(artifact_id, line): decision records as the JSON lines that `write_decisions` writes."""
    fields = [c for c in records.columns if c != "artifact_id"]
    order = ("cve", "component_purl", "verdict", "rule_id", "reason_code", "justification", "component", "statement_id", "evidence_bundle")
    return records.select("artifact_id", F.to_json(F.struct(*(c for c in order if c in fields))).alias("line"))


def write_report(rows: DataFrame, path: str, mode: str = "overwrite", order: tuple[str, ...] = ()) -> None:
    """A report as CSV with headers; with an `order` it is range-sorted, and its files in name order are the sorted report."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    ordered.write.mode(mode).option("header", "true").csv(path)


def write_document_rows(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows whose column `document` is JSON text, one document per line."""
    rows.select("document").write.mode(mode).text(path)


def write_evidence(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Evidence files as a table of (artifact, path, body, sha256)."""
    files.write.mode(mode).partitionBy("artifact_id").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def aggregate_document(rollup: DataFrame) -> DataFrame:
    """Coverage roll-up as JSON rows per level: totals, classes, artifacts."""
    fields = ("class", "artifact_id", "artifacts", "cves_in", "not_affected", "affected", "refused", "decided", "coverage_percent")
    return rollup.select("level", F.to_json(F.struct(*fields)).alias("document"))
