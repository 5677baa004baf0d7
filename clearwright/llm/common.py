"""Helpers that several operators share: shared folders, written tables, row keys, batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROWS_PER_BATCH = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's `spark.checkpoint.dir`.

    Where the setting is absent, a local session gets a folder of its own; any other
    master is an error, because its executors could not read a driver's folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in a shared folder: computed once, read by several jobs, and safe from lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Bound what a Python worker holds at once: texts may be long, so batches have few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def text_digest(text: str = "text") -> Column:
    """64 bits of a text; null has a value of its own.  Always used next to doc_id, to tell rows that share an id apart."""
    return F.coalesce(F.xxhash64(F.lit("t"), F.col(text)), F.lit(0))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, y) of at most about `bound` labelled documents outside the held-out fifth, a row per id.

    The sample is drawn by a hash of doc_id, so it is the same on every run.  Label rows
    without an id or a value are ignored; a document with several labels counts as 1 if any is 1.
    Of documents that share an id the text of the smallest digest stands for all, so repeats of an id
    do not enlarge the sample.  The rows come in no fixed order.
    """
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    total = ids.count()
    share = min(1.0, bound / max(1, total))
    drawn = ids.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + (share == 1.0))
    found = docs.select("doc_id", "text", text_digest().alias("digest")).join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", "digest").alias("text")).select("text", "y")
