"""A cleaning pipeline for training text over `documents`.

Quality classifier, SimHash near-duplicates, benchmark decontamination, personal data, BPE.  Every stage works
on all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwright.llm import bpe, decontaminate, pii, quality, simhash
from clearwright.llm.common import labelled_sample, table, written

KEEP_FROM = 0.3
SIMILARITY = 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    model = quality.train(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", quality.SAMPLE))
    scored = quality.score(docs, model, "quality_score")
    return scored.filter(F.col("quality_score") >= KEEP_FROM).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The representative of every near-duplicate group: fingerprints as op2 links them, or sets of five-word shingles similar by SIMILARITY (`llm/shingle_sets.py`)."""
    return simhash.keep_representatives(docs, SIMILARITY)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms taken out; n_chars follows the text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    coded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("bpe", encoded),
]

ORACLE_SQL = None  # classifier, fingerprints and BPE are beyond SQL; tests hold the pipeline against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
