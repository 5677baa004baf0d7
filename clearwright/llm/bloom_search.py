"""Ranked lexical search over bit-sliced Bloom signatures: upper bounds exclude documents, the rest is scored exactly.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z is lower-cased.  A score sums
w * ((1e9 * tf) div (1000 * tf + 12 * m)) over an item's terms, repeats included, with w = floor(1000 * ln((2N + 2) / (2df + 1)))
and m = 75 + (25 * n * N) div L, from counts over all documents.

Index (one pass over the documents).  A document is a row of a block, and a block is a matrix of bits that is
stored by slices: slice j holds bit j of all its rows.  A term sets PROBES bits for each power of two that its count reaches,
so the AND of a term's slices marks every row with that term (and a few more), and the next level's slices tell the
rows where it occurs 2, 4, 8, ... times.  Rows of a block have about equally many keys; its width is 8 to 16 bits a key.
Term counts by document are added up per task and stored next to the blocks.

Search (a batch of items at a time, of bounded size).  For each block the slices of the batch's terms are combined, and their
weighted sums are a bound of each row's score: a term counts with the highest count of its level.  The rows with the greatest
bounds are scored exactly; the `top`-th of these scores is a threshold, and every row whose bound reaches it is then
scored exactly on its whole text.  What is excluded cannot rank.  Of equal texts in a block only the `top` smallest ids are
scored, as the others would rank behind them.

Cases: null texts and texts without a term are no documents and match nothing; items without a term return no row; rows of
either table that repeat are documents and items of their own; a null doc_id ranks before others of equal score; empty
tables give an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from clearwright.llm.common import small_batches, text_digest, written

TOP = 20
SEEDS = 64
PROBES = 4
BITS_PER_KEY = 8
BLOCK_BITS = 1 << 24
MOST_ROWS = 4096
MOST_TERMS = 400_000
KEY_CHUNK, COUNT_ROWS = 1 << 16, 1 << 14
BATCH_ITEMS, BATCH_BYTES = 512, 1 << 20
_TERM_CHUNK = 512
_COMMON = 4
_LETTERS = bytes(b if b > 127 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_INDEX = ("term binary, df long, rows int, bits int, total long, n array<long>, doc_id array<long>, key array<long>, digests binary, slices binary")


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one whole text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def levels_of(tf: np.ndarray) -> np.ndarray:
    """How many powers of two, from 1 on, a count reaches."""
    return np.frexp(tf.astype(np.float64))[1]


def keys_of(hashes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """A 64-bit key for a term hash and a level."""
    x = hashes + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def slices_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """(keys, PROBES) slice numbers in a block of `bits` slices, a power of two."""
    low, step = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def contribution(tf, m):
    """The part of a score that a term's count adds, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def lengths(n, documents: int, total: int):
    """m of documents with n terms."""
    return 75 + (25 * n * documents) // total


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) > MOST_TERMS:
            self.clear()
        self[term] = h = xxh64_intdigest(term)
        return h


class _Open:
    """A block that is being filled: its bits are set row by row, so that no keys are held."""

    def __init__(self, bits: int):
        self.bits, self.most = bits, max(8, min(MOST_ROWS, BLOCK_BITS // bits))
        self.matrix = np.zeros((bits, -(-self.most // 8)), dtype=np.uint8)
        self.n, self.doc_ids, self.keys, self.digests = [], [], [], []

    def add(self, n: int, doc_id: int | None, key: int, digest: bytes, keys: np.ndarray) -> bool:
        """Whether the block is full now."""
        row = len(self.n)
        for at in range(0, len(keys), KEY_CHUNK):
            self.matrix[slices_of(keys[at:at + KEY_CHUNK], self.bits).ravel(), row >> 3] |= np.uint8(1 << (row & 7))
        for held, value in ((self.n, n), (self.doc_ids, doc_id), (self.keys, key), (self.digests, digest)):
            held.append(value)
        return len(self.n) >= self.most

    def batch(self) -> pa.RecordBatch:
        rows = len(self.n)
        values = [None, None, rows, self.bits, sum(self.n), self.n, self.doc_ids, self.keys, b"".join(self.digests), self.matrix[:, :-(-rows // 8)].tobytes()]
        return _batch([[v] for v in values])


def _batch(columns: list[list]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), longs, longs, longs, pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _INDEX.split(", ")])


def _document_counts(df: Counter) -> Iterator[pa.RecordBatch]:
    left = iter(df.items())
    while part := list(islice(left, COUNT_ROWS)):
        yield _batch([*map(list, zip(*part)), *([None] * len(part) for _ in range(8))])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, df, open_blocks = _Hashes(), Counter(), {}
    for batch in batches:
        for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
            words = terms_of(text)
            if not words:
                continue
            counts = Counter(words)
            df.update(counts.keys())
            if len(df) > MOST_TERMS:
                yield from _document_counts(df)
                df.clear()
            own = np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts))
            level = levels_of(np.fromiter(counts.values(), np.int64, len(counts)))
            keys = np.concatenate([keys_of(own[level > at], at) for at in range(level.max())])
            bits = 1 << max(6, math.ceil(math.log2(BITS_PER_KEY * len(keys))))
            block = open_blocks[bits] if bits in open_blocks else open_blocks.setdefault(bits, _Open(bits))
            if block.add(len(words), doc_id, key, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), keys):
                yield open_blocks.pop(bits).batch()
    for bits in list(open_blocks):
        yield open_blocks.pop(bits).batch()
    yield from _document_counts(df)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: rows with `slices` are blocks, rows with `term` are document counts of one task."""
    small_batches(docs.sparkSession, 256)
    return written(docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("key"), F.col(text).alias("text")).mapInArrow(_build, _INDEX), "bloom-index")


class Items:
    """A batch of items: their terms, how often each item has them, and their weights."""

    def __init__(self, rows: list[tuple[int, list[bytes]]]):
        self.ids = [i for i, _ in rows]
        counted = [Counter(words) for _, words in rows]
        self.terms = sorted(set().union(*counted))
        number = {t: k for k, t in enumerate(self.terms)}
        self.of_item = [[(t, number[t], times) for t, times in c.items()] for c in counted]
        self.weights = np.zeros(len(self.terms), dtype=np.int64)
        self.hashes = np.array([xxh64_intdigest(t) for t in self.terms], dtype=np.uint64)
        self.documents = self.total = 0

    def weigh(self, index: DataFrame) -> None:
        """Take N, L and the weights from the index."""
        spark = index.sparkSession
        self.documents, self.total = index.filter("rows is not null").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        wanted = spark.createDataFrame([(bytearray(t),) for t in self.terms], "wanted binary")
        found = index.filter("term is not null").join(wanted, F.col("term") == F.col("wanted")).groupBy("term").agg(F.sum("df").alias("df"))
        df = {bytes(r.term): r.df for r in found.collect()}
        self.weights = np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df.get(t, 0) + 1))) for t in self.terms], dtype=np.int64)

    def score(self, item: int, counts: Counter, m: int) -> int:
        """The exact score of a document with these term counts."""
        return sum(int(self.weights[k]) * times * contribution(tf, m) for t, k, times in self.of_item[item] if (tf := counts[t]))

    def by_term(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each term its items and weights in them."""
        out = [([], []) for _ in self.terms]
        for item, terms in enumerate(self.of_item):
            for _, k, times in terms:
                out[k][0].append(item)
                out[k][1].append(float(self.weights[k]) * times)
        return [(np.array(a), np.array(b)) for a, b in out]


def upper_bounds(slices: np.ndarray, n: np.ndarray, items: Items, by_term: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(items, rows): numbers that no score exceeds, from weighted sums of slices."""
    bits, rows = len(slices), len(n)
    m = lengths(n, items.documents, items.total)
    table = [np.zeros(rows)]
    bound = np.zeros((len(items.ids), rows))
    for at in range(0, len(items.terms), _TERM_CHUNK):
        hashes = items.hashes[at:at + _TERM_CHUNK]
        level = np.zeros((len(hashes), rows), dtype=np.uint8)
        active, present, depth = np.arange(len(hashes)), None, 0
        while len(active):
            marks = np.bitwise_and.reduce(slices[slices_of(keys_of(hashes[active], depth), bits)], axis=1)
            present = marks if present is None else present & marks
            some = present.any(axis=1)
            active, present, depth = active[some], present[some], depth + 1
            level[active] += np.unpackbits(present, axis=1, count=rows, bitorder="little")
        while len(table) <= depth:
            table.append(contribution(np.int64((1 << len(table)) - 1), m).astype(np.float64))
        values = np.stack(table)
        t, d = np.nonzero(level)
        value = values[level[t, d], d]
        ends = np.searchsorted(t, np.arange(len(hashes) + 1))
        few_item, few_row, few_value = [], [], []
        for k in np.nonzero(np.diff(ends))[0].tolist():
            part = slice(ends[k], ends[k + 1])
            of, weight = by_term[at + k]
            if len(of) > _COMMON:
                bound[of[:, None], d[part][None]] += weight[:, None] * value[part][None]
            else:
                for item, w in zip(of.tolist(), weight.tolist()):
                    few_item.append(np.full(part.stop - part.start, item)), few_row.append(d[part]), few_value.append(w * value[part])
        if few_item:
            flat = np.concatenate(few_item) * rows + np.concatenate(few_row)
            bound += np.bincount(flat, np.concatenate(few_value), bound.size).reshape(bound.shape)
    return bound * (1 + 1e-12)  # sums of doubles may round down


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """slices, n, doc ids, keys and digests of each block."""
    for i in range(len(batch)):
        rows, bits = batch.column("rows")[i].as_py(), batch.column("bits")[i].as_py()
        n, ids, keys = (batch.column(c)[i].values for c in ("n", "doc_id", "key"))
        digests = np.frombuffer(batch.column("digests")[i].as_buffer(), dtype=np.uint64).reshape(rows, 4)
        yield np.frombuffer(batch.column("slices")[i].as_buffer(), dtype=np.uint8).reshape(bits, -1), n.to_numpy(), ids, keys.to_numpy(), digests


def _behind(ids: pa.Array, digests: np.ndarray, top: int) -> np.ndarray:
    """Rows behind `top` rows with the same text and smaller ids."""
    number = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
    order = np.lexsort((number, *digests.T))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (digests[order][1:] != digests[order][:-1]).any(axis=1)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    behind = np.zeros(len(order), dtype=bool)
    behind[order] = np.arange(len(order)) - first >= top
    return behind


_FOUND = "item int, doc_id long, key long, bound double"


def _found(item: np.ndarray, row: np.ndarray, ids: pa.Array, keys: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(row)), pa.array(keys[row]), pa.array(bound[item, row])], ["item", "doc_id", "key", "bound"])


def _greatest(items: Items, count: int):
    """The rows with the greatest bounds of a task, at most `count` an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term, held = items.by_term(), None
        for batch in batches:
            for slices, n, ids, keys, _ in _blocks(batch):
                bound = upper_bounds(slices, n, items, by_term)
                pick = np.argpartition(-bound, min(count, len(n)) - 1, axis=1)[:, :count]
                item, row = np.repeat(np.arange(len(bound)), pick.shape[1]), pick.ravel()
                positive = bound[item, row] > 0
                table = pa.Table.from_batches([_found(item[positive], row[positive], ids, keys, bound)])
                held = table if held is None else pa.concat_tables([held, table])
                if len(held) > 8 * count * len(bound):
                    held = _cut(held, count)
        if held is not None:
            yield from _cut(held, count).combine_chunks().to_batches()

    return run


def _cut(held: pa.Table, count: int) -> pa.Table:
    item, bound = held["item"].to_numpy(), held["bound"].to_numpy()
    order = np.lexsort((-bound, item))
    ranks = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    return held.take(pa.array(order[ranks < count]))


def _reaching(items: Items, thresholds: np.ndarray, top: int):
    """Every row whose bound reaches the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term = items.by_term()
        for batch in batches:
            for slices, n, ids, keys, digests in _blocks(batch):
                bound = upper_bounds(slices, n, items, by_term)
                reach = (bound >= thresholds[:, None]) & (bound > 0)
                reach[:, _behind(ids, digests, top)] = False
                yield _found(*np.nonzero(reach), ids, keys, bound)

    return run


def _exact(docs: DataFrame, found: DataFrame, items: Items, name: str) -> DataFrame:
    """(item, doc_id, score) of found rows, from their whole texts."""
    wanted = written(found.groupBy(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).agg(F.collect_set("item").alias("items")), f"{name}-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, numbers in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
                words = terms_of(text)
                counts, m = Counter(words), lengths(len(words), items.documents, items.total)
                out += [(i, doc_id, items.score(i, counts, m)) for i in numbers]
            item, ids, score = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    keyed = docs.withColumn("key", text_digest())
    joined = keyed.join(wanted, keyed.doc_id.eqNullSafe(wanted.of) & (keyed.key == wanted.of_key)).select("doc_id", "text", "items")
    small_batches(docs.sparkSession, 256)
    scored = joined.mapInArrow(run, "item int, doc_id long, score long").filter("score > 0")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return scored.withColumn("rank", F.row_number().over(best))


def _search(docs: DataFrame, index: DataFrame, items: Items, top: int) -> DataFrame:
    items.weigh(index)
    spark = docs.sparkSession
    blocks = index.filter("rows is not null").select("rows", "bits", "n", "doc_id", "key", "digests", "slices")
    best = Window.partitionBy("item").orderBy(F.col("bound").desc())
    small_batches(spark, 4)
    seeds = written(blocks.mapInArrow(_greatest(items, SEEDS), _FOUND).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= max(SEEDS, top)), "bloom-seeds")
    thresholds = np.zeros(len(items.ids))
    for row in _exact(docs, seeds, items, "bloom-seeds").filter(F.col("rank") == top).collect():
        thresholds[row.item] = row.score
    small_batches(spark, 4)
    reaching = written(blocks.mapInArrow(_reaching(items, thresholds, top), _FOUND), "bloom-candidates")
    ranked = written(_exact(docs, reaching, items, "bloom-candidates").filter(F.col("rank") <= top), "bloom-ranks")
    names = spark.createDataFrame(list(enumerate(items.ids)), "of_item int, item_id long")
    return ranked.join(names, F.col("item") == F.col("of_item")).select("item_id", "rank", "doc_id", "score")


def _batches(queries: DataFrame) -> Iterator[Items]:
    """Batches of at most BATCH_ITEMS items and about BATCH_BYTES of terms."""
    held, size = [], 0
    for row in queries.toLocalIterator():
        if words := terms_of(row.text):
            held.append((row.item_id, words))
            size += sum(map(len, words))
        if len(held) >= BATCH_ITEMS or size >= BATCH_BYTES:
            yield Items(held)
            held, size = [], 0
    if held:
        yield Items(held)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents (doc_id, text) of each row of `queries` (item_id, text)."""
    plain = docs.select("doc_id", "text")
    index = build_index(plain) if index is None else index
    parts = [_search(plain, index, items, top) for items in _batches(queries.select("item_id", "text"))]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
