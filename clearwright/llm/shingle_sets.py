"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

Law: A-Z lower-cased, words are runs of anything but space and \\x09-\\x0D, the set holds the hashes of all runs of `width`
words (fewer words: one shingle; none: no set, and no link).  Two texts link if |A and B| / |A or B| >= similarity, checked on
the whole sets.  Candidates share one of BANDS keys of ROWS MinHash values: a pair at similarity s is met with
1 - (1 - s^ROWS)^BANDS, which is 0.999997 at 0.8.

Only a node (the text's digest), the set's size and the keys are stored of every text.  Sets are built again, from the text, for nodes
that share a key.  A bucket's members first meet its smallest node; each set travels once per different head.  Buckets that
are not one group by then are compared in blocks, where a bitmap bounds the intersection from above before sets are merged, and a block
returns joining links only.  Hot heads and hot buckets are dealt to many tasks, so no task holds more than BLOCK sets of
a side, and near copies never form all their pairs.  Buckets of two nodes, and buckets of the same nodes as another, are not compared again.

Cases: null and empty texts have no set; equal texts are one node; repeated rows are met once per task; an empty table has no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from clearwright.llm.common import small_batches, text_digest, written
from clearwright.llm.components import connected_components

SEED = 42
BANDS, ROWS = 32, 5
BLOCK = 512
BITMAP = 4096
_SEEN = 1_000_000
_MIX = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends - 1)[min(width, len(words)) - 1:].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=n))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of MinHash values; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[at:at + 2048, None] ^ _MIX[0]) * _MIX[1]).min(axis=0))
    return np.array([xxh64_intdigest(least[b * ROWS:(b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], dtype=np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if not similarity * max(len(a), len(b)) <= min(len(a), len(b)) + 1e-9:
        return False
    common = np.intersect1d(a, b, assume_unique=True).size
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP, dtype=np.uint8)
    bits[(hashes % np.uint64(BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def may_be_similar(maps: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int, similarity: float) -> np.ndarray:
    """False only where the sets cannot be similar: a bit that one map has alone stands for an element the other lacks."""
    only = np.bitwise_count(maps & ~one).sum(axis=1, dtype=np.int64)
    other = np.bitwise_count(one & ~maps).sum(axis=1, dtype=np.int64)
    common = np.minimum(sizes - only, size - other)
    return common >= similarity * (sizes + size - common) - 1e-9


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(shingle_set(t, width)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    return run


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """`wanted` (node, ...) with the set of each node; a task makes a repeated row's set once."""
    carried = [c for c in wanted.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in carried]
            keep, sets, last, made = [], [], None, None
            for i, (row, text) in enumerate(zip(zip(*columns), batch.column("text").to_pylist())):
                if row in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(row)
                if row[0] != last:
                    last, made = row[0], shingle_set(text, width).view(np.int64)
                keep.append(i)
                sets.append(made)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in carried), pa.array(sets, pa.list_(pa.int64()))], [*carried, "shingles"])

    schema = ", ".join(f"{n} {t}" for n, t in wanted.dtypes)
    small_batches(texts.sparkSession, 256)
    return texts.join(wanted, "node").select(*carried, "text").mapInArrow(run, f"{schema}, shingles array<bigint>")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], names: tuple[str, ...]) -> Iterator[dict]:
    """Rows of a sorted stream, one dictionary of columns per run of equal keys and batch; `first` marks a new run."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*keys, *names)}
        new = np.ones(len(batch), dtype=bool)
        new[1:] = np.any([columns[k][1:] != columns[k][:-1] for k in keys], axis=0)
        starts = np.nonzero(new)[0].tolist()
        lists = batch.column("shingles")
        for s, e in zip(starts, [*starts[1:], len(batch)]):
            key = tuple(columns[k][s] for k in keys)
            yield {"first": key != last, **{n: columns[n][s:e] for n in names}, "key": key,
                   "sets": [lists[i].values.to_numpy().view(np.uint64) for i in range(s, e)]}
            last = key


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _with_heads(texts: DataFrame, pairs: DataFrame, width: int, similarity: float, block: int) -> DataFrame:
    """Those of `pairs` (head, node) that are similar."""
    parts = pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    members = pairs.join(parts, "head").select(
        "node", "head", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"))
    heads = parts.select(F.col("head").alias("node"), "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    wanted = written(members.unionByName(heads), "similar-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for group in _groups(batches, ("head", "part"), ("node", "member")):
            found = []
            if group["first"]:
                head = None
            for node, member, own in zip(group["node"].tolist(), group["member"].tolist(), group["sets"]):
                if not member:
                    head = own.copy()
                elif head is not None and similar(head, own, similarity):
                    found.append((group["key"][0], node))
            yield _links_batch(found)

    dealt = _sets(texts, wanted, width).repartition("head", "part").sortWithinPartitions("head", "part", "member", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _in_buckets(texts: DataFrame, rows: DataFrame, width: int, similarity: float, block: int) -> DataFrame:
    """Links that join groups inside buckets (key, node, group)."""
    parts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    dealt = (
        rows.join(parts, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("node", "key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "group"))
    wanted = written(dealt, "similar-buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, groups, chunks, sets, maps, at = [], [], [], [], [], {}
        for part in _groups(batches, ("key", "low", "high"), ("node", "chunk", "group")):
            if part["first"]:
                nodes, groups, chunks, sets, maps, at = [], [], [], [], [], {}
            apart, found = part["key"][1] != part["key"][2], []

            def root(g: int) -> int:
                while at.get(g, g) != g:
                    g = at[g]
                return g

            for node, chunk, group, own in zip(part["node"].tolist(), part["chunk"].tolist(), part["group"].tolist(), part["sets"]):
                if nodes and nodes[-1] == node:
                    continue
                own, mark = own.copy(), bitmap(own)
                if nodes:
                    sizes = np.array([len(s) for s in sets])
                    likely = may_be_similar(np.stack(maps), sizes, mark, len(own), similarity)
                    for i in np.nonzero(likely)[0].tolist():
                        if (apart and chunks[i] == chunk) or root(groups[i]) == root(group):
                            continue
                        if similar(sets[i], own, similarity):
                            found.append((nodes[i], node))
                            at[max(root(groups[i]), root(group))] = min(root(groups[i]), root(group))
                nodes.append(node), groups.append(group), chunks.append(chunk), sets.append(own), maps.append(mark)
            yield _links_batch(found)

    sorted_rows = _sets(texts, wanted, width).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return sorted_rows.mapInArrow(run, "a long, b long")


def open_buckets(grouped: DataFrame) -> DataFrame:
    """(key): the buckets of (key, node, group) to compare after their heads have met all members.

    Buckets of one group are done, and so are buckets of two nodes: one of them was the head.  Of buckets with the same nodes,
    as told by their number and 128 bits of their nodes' hashes, one is enough.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), "node")).alias(f"mark{salt}") for salt in (0, 1)]
    buckets = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("members"), *marks)
    return buckets.filter("low != high AND members > 2").groupBy("members", "mark0", "mark1").agg(F.min("key").alias("key")).select("key")


def similar_links(docs: DataFrame, similarity: float, width: int = 5, text: str = "text", block: int = BLOCK) -> DataFrame:
    """(a, b): text digests whose sets are similar, enough of them to connect what is connected."""
    small_batches(docs.sparkSession)
    texts = docs.select(text_digest(text).alias("node"), F.col(text).alias("text"))
    keys = texts.mapInArrow(_sketch(width), "node long, keys array<long>").dropDuplicates(["node"])
    rows = written(keys.select("node", F.explode("keys").alias("key")), "similar-keys")
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    met = written(rows.join(heads, "key"), "similar-met")
    pairs = written(met.filter("node != head").select("head", "node").distinct(), "similar-pairs")
    first = written(_with_heads(texts, pairs, width, similarity, block), "similar-heads")
    linked = connected_components(first, "a", "b").withColumnRenamed("node", "of")
    grouped = met.join(linked, met.node == F.col("of"), "left").select("key", "node", F.coalesce("component", "node").alias("group"))
    left = written(grouped.join(open_buckets(grouped), "key", "left_semi"), "similar-open")
    return first.unionByName(_in_buckets(texts, left, width, similarity, block))
