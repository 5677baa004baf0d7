"""SimHash near-duplicates: pigeonring candidate filter, full Hamming check, components.

Fingerprint: A-Z lower-cased, words are runs of anything but space and \\x09-\\x0D, shingles are
`width` consecutive words joined by a space (repeats count; fewer words: one shingle; none:
fingerprint zero).  A bit is set if more than half of the shingles' XXH64 values (seed 42) have it.

Filter: the 64 bits form a ring of `segments` pieces.  Two fingerprints at distance <= tau have a
start on the ring from which *every* chain of l pieces differs by at most floor(l * tau / segments)
bits.  The pieces with budget 0 are compared as a key; those up to budget 1 are cut in two halves,
one of which must be equal too, so that half joins the key.  Chains are checked next, and the full
distance last.  The filter is exact: no pair within tau is lost.

keep_representatives can also link texts by the similarity of their shingle sets (`shingle_sets.py`).

Cases: null and empty texts have fingerprint 0 and link like any other; equal fingerprints are one
node, so copies never form pairs; rows that share a doc_id link through their texts only; a null
doc_id is ignored as a minimum; an empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from clearwright.llm.common import small_batches, text_digest, written
from clearwright.llm.components import connected_components
from clearwright.llm.shingle_sets import similar_links

SEED = 42
BLOCK = 2048
_HASHES_AT_ONCE = 65_536


def simhash(text: str | None, width: int = 3) -> int:
    """Signed 64-bit fingerprint of one text; the bit counts are taken in bounded pieces."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n], ends[width - 1:] if len(words) >= width else ends[-1:])
    counts = np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in spans), dtype=np.uint64, count=n)
    for at in range(0, n, _HASHES_AT_ONCE):
        part = hashes[at:at + _HASHES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n)
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 3) -> DataFrame:
    """`docs` with a fingerprint column (a column of that name is replaced)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return docs.withColumn(out, fingerprint(F.col(text)))


def budgets(segments: int, tau: int) -> list[int]:
    """Differences allowed in a chain of 1, 2, … segments."""
    return [length * tau // segments for length in range(1, segments + 1)]


def _keys(fp: str, segments: int, tau: int):
    """One 64-bit key per ring start and half of the budget-1 pieces; the number of start and half leads."""
    size, allowed = 64 // segments, budgets(segments, tau)
    exact = size * sum(b == 0 for b in allowed)
    near = size * sum(b == 1 for b in allowed)
    half = near // 2
    wide = exact + near - half
    if not exact or wide + 1 + segments.bit_length() > 63:
        raise ValueError("use more segments than differing bits, and shorter keys")
    keys = []
    for start in range(segments):
        turn = size * start
        ring = F.col(fp) if not turn else F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn))
        head = F.shiftrightunsigned(ring, 64 - exact)
        for part in range(2 if half else 1):
            bits = half if part == 0 else near - half
            tail = F.shiftrightunsigned(ring, 64 - exact - (half if part == 0 else near)).bitwiseAND(F.lit((1 << bits) - 1))
            keys.append(F.lit((start * 2 + part) << wide).bitwiseOR(F.shiftleft(head, bits)).bitwiseOR(tail))
    return F.array(*keys), wide + 1


def _links(segments: int, tau: int, start_bit: int):
    """Spanning links of every bucket in a stream sorted by bucket; a bucket has at most 2 * BLOCK rows."""
    size, allowed = 64 // segments, np.array(budgets(segments, tau))
    mask = np.uint64((1 << size) - 1)

    def chained(x: np.ndarray, start: np.ndarray) -> np.ndarray:
        total, ok = np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=bool)
        for step in range(segments):
            piece = (start + step) % segments
            shift = (64 - size * (piece + 1)).astype(np.uint64)
            total += np.bitwise_count((x >> shift) & mask)
            ok &= total <= allowed[step]
        return ok

    def pairs(fp: np.ndarray, start: np.ndarray, block: np.ndarray, chunk: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
        root, out = np.arange(len(fp)), []
        active, step = np.nonzero(end - np.arange(len(fp)) > 1)[0], 1
        while len(active):
            other = active + step
            use = (root[active] != root[other]) & (~block[active] | (chunk[active] != chunk[other]))
            i, j = active[use], other[use]
            x = fp[i] ^ fp[j]
            ok = chained(x, start[i])
            i, j, x = i[ok], j[ok], x[ok]
            ok = np.bitwise_count(x) <= tau
            for p, q in zip(i[ok].tolist(), j[ok].tolist()):
                a, b = p, q
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((p, q))
            while not np.array_equal(root, root[root]):
                root = root[root]
            step += 1
            active = active[active + step < end[active]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        group = ("key", "ba", "bb")

        def close(rows: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
            new = np.ones(n, dtype=bool)
            new[1:] = np.any([rows[k][1:n] != rows[k][:n - 1] for k in group], axis=0)
            first = np.nonzero(new)[0]
            end = np.append(first[1:], n)[np.cumsum(new) - 1]
            fp = rows["fp"][:n].view(np.uint64)
            found = np.array(pairs(fp, rows["key"][:n] >> start_bit, rows["ba"][:n] != rows["bb"][:n], rows["chunk"][:n], end), dtype=np.int64).reshape(-1, 2)
            signed = rows["fp"][:n]
            return pa.RecordBatch.from_arrays([pa.array(signed[found[:, 0]]), pa.array(signed[found[:, 1]])], ["a", "b"])

        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*group, "chunk", "fp")}
            if rest is not None:
                rows = {k: np.concatenate((rest[k], rows[k])) for k in rows}
            apart = np.any([rows[k] != rows[k][-1:] for k in group], axis=0)
            cut = int(np.nonzero(apart)[0][-1]) + 1 if apart.any() else 0
            if cut:
                yield close(rows, cut)
            rest = {k: v[cut:] for k, v in rows.items()}
        if rest is not None and len(rest["fp"]):
            yield close(rest, len(rest["fp"]))

    return run


def near_links(nodes: DataFrame, fp: str = "fp", tau: int = 3, segments: int = 8, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints at most `tau` bits apart, enough of them to connect what is connected.

    A bucket of more than `block` fingerprints is dealt as pairs of blocks to many tasks; inside a
    block distances are compared as vectors and only links that join two parts are returned,
    so a dense group of g near copies gives at most a few times g rows.
    """
    small_batches(nodes.sparkSession, 50_000)
    keys, start_bit = _keys(fp, segments, tau)
    rows = nodes.select(F.col(fp).alias("fp"), F.explode(keys).alias("key"))
    hot = (
        rows.groupBy(F.col("key").alias("hot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
        .select("hot", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    )
    dealt = (
        rows.join(hot, rows.key == hot.hot, "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("chunk", "other").alias("ba"), F.greatest("chunk", "other").alias("bb"), "chunk", "fp")
    )
    group = ["key", "ba", "bb"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_links(segments, tau, start_bit), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = 3, segments: int = 8) -> DataFrame:
    """(doc_id, digest, fp, label, component_id), a row per row of `docs`.

    label names the linked group by its smallest fingerprint, component_id by its smallest id.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written(fingerprints(plain, out="fp").select("doc_id", text_digest().alias("digest"), "fp"), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = connected_components(near_links(nodes, tau=tau, segments=segments), "a", "b")
    labelled = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    labelled = written(labelled, "simhash-nodes")
    smallest = labelled.groupBy(F.col("label").alias("of")).agg(F.min("least").alias("component_id"))
    classes = labelled.join(smallest, labelled.label == smallest.of).select(F.col("fp").alias("at"), "label", "component_id")
    return rows.join(classes, rows.fp == classes.at, "left").select("doc_id", "digest", "fp", "label", "component_id")


def hex_fingerprint(fp: str = "fp"):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_representatives(docs: DataFrame, similarity: float | None = None, set_width: int = 5) -> DataFrame:
    """The row of each near-duplicate group with the smallest (doc_id, text digest), a null id being the smallest; repeats of it once.

    Groups are linked by fingerprints, and with a `similarity` also by the Jaccard similarity of shingle sets.
    """
    found = near_duplicates(docs)
    if similarity is not None:
        at = found.select(F.col("digest").alias("node"), F.col("label").alias("of_node")).distinct()
        links = similar_links(docs, similarity, set_width)
        for end in ("a", "b"):
            links = links.join(at.select(F.col("node").alias(end), F.col("of_node").alias(f"label_{end}")), end)
        joined = connected_components(links.select("label_a", "label_b").filter("label_a != label_b"), "label_a", "label_b")
        found = found.join(joined, found.label == joined.node, "left").select("doc_id", "digest", F.coalesce("component", "label").alias("label"))
    times = found.groupBy("label", "doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
    kept = times.groupBy("label").agg(F.min(F.struct("doc_id", "digest", "times")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.digest").alias("kept_digest"), "k.times")
    # The columns travel under names of ours, so that none can clash; the two joins below read the same shuffle of them.
    names = [f"column{i}" for i in range(len(docs.columns))]
    keyed = docs.select(F.col("doc_id").alias("of_id"), text_digest().alias("of_digest"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    same = keyed.of_id.eqNullSafe(kept.kept_id) & (keyed.of_digest == kept.kept_digest)
    # Only rows that are there more than once are shuffled again, to take one of them.
    once = keyed.join(kept.filter("times = 1"), same, "left_semi")
    repeated = keyed.join(kept.filter("times > 1"), same, "left_semi").dropDuplicates(["of_id", "of_digest"])
    return once.union(repeated).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
