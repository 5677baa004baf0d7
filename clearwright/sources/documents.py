"""Whole documents as rows: (doc_id, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, id_pattern: str = r"([^/]+)$") -> DataFrame:
    """One row per file under `path`; `doc_id` is cut from the file path by `id_pattern`."""
    return (
        spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        .select(F.regexp_extract("_metadata.file_path", id_pattern, 1).alias("doc_id"), F.col("value").alias("content"))
    )


def _lines(spark: SparkSession, path: str, id_pattern: str | None) -> DataFrame:
    own = F.lit("") if id_pattern is None else F.regexp_extract("_metadata.file_path", id_pattern, 1)
    return spark.read.text(path).select(own.alias("artifact_id"), "value").where(F.trim("value") != "")


def _is_broken(value: Column, schema: str) -> Column:
    record = F.from_json(value, f"{schema}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    return F.coalesce(record["_broken"].isNotNull(), F.lit(True))


def read_json_lines(spark: SparkSession, path: str, schema: str, id_pattern: str | None = None, skip_broken: bool = False) -> DataFrame:
    """JSON lines with a fixed schema.  A malformed line fails the job, unless the caller skips and reads `broken_lines`.

    With `id_pattern`, column `artifact_id` is cut from the file path.
    """
    lines = _lines(spark, path, id_pattern)
    if skip_broken:
        lines = lines.where(~_is_broken(F.col("value"), schema))
    parsed = lines.select("artifact_id", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select(*([] if id_pattern is None else ["artifact_id"]), "r.*")


def broken_lines(spark: SparkSession, path: str, schema: str, id_pattern: str | None = None) -> DataFrame:
    """(artifact_id, value, reason): malformed lines."""
    lines = _lines(spark, path, id_pattern).where(_is_broken(F.col("value"), schema))
    return lines.withColumn("reason", F.lit("not a JSON object of this kind"))


def broken_documents(docs: DataFrame, schema: str) -> DataFrame:
    """(doc_id, reason): documents whose content is not a JSON object of the schema."""
    return docs.where(_is_broken(F.col("content"), schema)).select("doc_id", F.lit("not a JSON object of this kind").alias("reason"))


def is_list(column: str = "content"):
    return F.ltrim(F.col(column)).startswith("[")
