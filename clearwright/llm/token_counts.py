"""Token counts through a digest cache: only texts that no run has counted before are encoded, each once.

The cache is a Parquet folder with a row per (version, digest): version is the SHA-256 of the tokenizer
file, digest that of the normalised text.  Normalising keeps the count: null becomes the empty
text, and U+2581 becomes the space that the tokenizer treats alike.  Misses are deduplicated by
digest (partly before the shuffle, so a copied text is moved once per task), encoded, and appended; then
every row takes its count from the cache.  Appending is one Spark write, so a lost executor costs its
tasks only, and a repeated append of equal rows does no harm.

Cases: null and empty texts have 0 tokens; texts are encoded whole at any length; rows that share an
id are counted apart; an empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.llm.common import small_batches, written

SPACE = "▁"
MEMO = 600_000


def content(text: str = "text") -> Column:
    """The normalised text."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def digest(text: str = "text") -> Column:
    """32 bytes that stand for the normalised text."""
    return F.unhex(F.sha2(content(text), 256))


class Counter(dict):
    """Counts of chunks; a chunk is a word with the spaces before it, less one.

    No piece of the vocabulary has a space after another character, so merges never cross the start
    of such a chunk and counts add up.  A vocabulary where one does, or that treats spaces otherwise,
    is counted by whole texts.
    """

    def __init__(self, model: bytes):
        super().__init__()
        owner = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.encode = encode = owner.encode
        pieces = map(owner.id_to_piece, range(owner.vocab_size()))
        self.splits = (
            not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
            and encode("a b") == encode("a") + encode("b") and encode("a  b") == encode("a") + encode(" b")
            and encode(" a") != encode("a") and len(encode("a ")) == len(encode("a")) + 1
        )

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not kept yet, in one call."""
        if len(self) + len(chunks) > MEMO:
            self.clear()
        chunks = list(chunks)
        self.update(zip(chunks, map(len, self.encode(chunks, num_threads=1))))

    def _chunks(self, text: str) -> list[str]:
        parts = text.split(" ")
        if "" not in parts:
            return parts
        return [w[1:] for w in re.findall(" +[^ ]+", " " + text)]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text.  New chunks are encoded together; a batch of more than MEMO chunks is taken in parts."""
        texts = [t.replace(SPACE, " ") for t in texts]
        if not self.splits:
            return [len(self.encode(t)) for t in texts]
        chunks = [self._chunks(t) if t.strip(" ") else [] for t in texts]
        out = [0] * len(texts)
        part: list[tuple[int, list[str]]] = []
        held = 0
        for i, words in enumerate(chunks):
            for at in range(0, len(words), MEMO // 2):
                part.append((i, words[at:at + MEMO // 2]))
                held += len(part[-1][1])
                if held >= MEMO // 2:
                    self._add(part, out)
                    part, held = [], 0
        self._add(part, out)
        for i, text in enumerate(texts):
            tail = len(text) - len(text.rstrip(" "))
            if tail == len(text):
                out[i] = len(self.encode(text))
            elif tail:
                out[i] += 1 if tail == 1 else len(self.encode(" " * (tail - 1)))
        return out

    def _add(self, part: list[tuple[int, list[str]]], out: list[int]) -> None:
        wanted = set().union(*(words for _, words in part))
        if missing := wanted.difference(self):
            kept = len(self)
            self.learn(missing)
            if len(self) < kept + len(missing):
                self.learn(wanted.difference(self))
        for i, words in part:
            out[i] += sum(map(self.__getitem__, words))


@lru_cache(maxsize=1)
def sentencepiece_counter(model: bytes) -> Callable[[list[str]], list[int]]:
    """One counter per Python worker, so that tasks share what it has learned."""
    return Counter(model).counts


def _encode(model: bytes, make: Callable[[bytes], Callable[[list[str]], list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make(model)
        for batch in batches:
            counts = pa.array(count(batch.column("content").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], ["digest", "n_tokens"])

    return run


def version_of(model_file: str) -> str:
    return hashlib.sha256(Path(model_file).read_bytes()).hexdigest()


def read_cache(docs: DataFrame, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) of one tokenizer version; None where nothing is stored yet."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={version}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/version={version}")


def update_cache(docs: DataFrame, cache: str, model_file: str, text: str = "text",
                 make: Callable[[bytes], Callable[[list[str]], list[int]]] = sentencepiece_counter) -> None:
    """Append the counts of texts that the cache lacks."""
    small_batches(docs.sparkSession)
    version = version_of(model_file)
    wanted = docs.select(digest(text).alias("digest"), content(text).alias("content"))
    known = read_cache(docs, cache, version)
    if known is not None:
        wanted = wanted.join(known, "digest", "left_anti")
    misses = wanted.groupBy("digest").agg(F.first("content").alias("content"))
    counted = misses.mapInArrow(_encode(Path(model_file).read_bytes(), make), "digest binary, n_tokens long")
    counted.write.mode("append").parquet(f"{cache}/version={version}")


def count_tokens(docs: DataFrame, cache: str, model_file: str, limit: int = 4096, text: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row per row of `docs`; the cache holds all its texts afterwards."""
    update_cache(docs, cache, model_file, text, **options)
    counts = read_cache(docs, cache, version_of(model_file)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = written(counts, "token-counts")  # a stored side lets the join split a hot digest
    keyed = docs.select("doc_id", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), digest(text).alias("of"))
    return keyed.join(counts, keyed.of == counts.digest, "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
