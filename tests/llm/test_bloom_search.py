"""Rankings against plain scoring of every document, and the bounds themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from tables import SF, documents, empty, rows

from clearwright.llm import bloom_search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(data, items, top=20):
    docs = [(i, Counter(w)) for i, t in data if (w := words(t))]
    total, n_docs = sum(c.total() for _, c in docs), len(docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        wanted, scores = Counter(words(text)), []
        for i, c in docs:
            m = 100 - 25 + 25 * c.total() * n_docs // total
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in wanted.items() if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, *_, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(map(repr, out))


def result(df):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def queries(spark, items):
    return spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, term string, score int")


ITEMS = [(1, "w1 w2 W3 w3 w59"), (2, "word one TWO x"), (3, None), (4, "... !"), (5, "Ärger École 漢字"), (1, "w1 w2 W3 w3 w59"), (6, "absent terms"), (None, "w7 w8"),
         (7, " ".join(f"w{i}" for i in range(60)) + " w1" * 30)]


def test_terms():
    for _, text in rows():
        assert [w.decode() for w in S.terms_of(text)] == words(text)


def test_awkward_rows(spark):
    data = rows()
    got = S.search(documents(spark, data), queries(spark, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert result(got) == brute(data, ITEMS)


def test_small_blocks_batches_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_ROWS", 16)
    monkeypatch.setattr(S, "BATCH_ITEMS", 2)
    monkeypatch.setattr(S, "MOST_TERMS", 50)
    data = rows(5, 60) + [(1000 - i, "w1 w2 w3 a text with many copies") for i in range(90)]
    assert result(S.search(documents(spark, data), queries(spark, ITEMS), top=3)) == brute(data, ITEMS, 3)


def test_empty_tables(spark):
    docs, items = documents(spark), queries(spark, ITEMS)
    assert S.search(empty(docs), items).collect() == []
    assert S.search(docs, empty(items)).collect() == []


def test_bounds_hold_and_exclude(spark):
    rnd = random.Random(8)
    vocabulary = [f"t{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    data = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 300)))) for i in range(800)]
    index = S.build_index(documents(spark, data, clash=False))
    items = S.Items([(k, [w.encode() for w in rnd.sample(vocabulary, 12)]) for k in range(10)])
    items.weigh(index)
    assert (items.documents, items.total) == (800, sum(len(t.split()) for _, t in data))
    texts = dict(data)
    loose = seen = 0
    for row in index.filter("rows is not null").collect():
        slices = np.frombuffer(bytes(row.slices), dtype=np.uint8).reshape(row.bits, -1)
        bound = S.upper_bounds(slices, np.array(row.n), items, items.by_term())
        for d, i in enumerate(row.doc_id):
            counts = Counter(S.terms_of(texts[i]))
            m = S.lengths(counts.total(), items.documents, items.total)
            for k in range(10):
                exact = items.score(k, counts, m)
                assert exact <= bound[k, d]
                loose, seen = loose + bound[k, d] - exact, seen + max(exact, 1)
    assert loose < 0.25 * seen


def test_query(spark):
    from clearwright.llm.queries import QUERIES

    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert result(QUERIES["op11_bloom_search"](spark, SF)) == brute(data, items)


def test_blocks_are_filled_in_little_memory():
    import tracemalloc

    text = " ".join(f"w{i}" for i in range(8192))
    batch = pa.RecordBatch.from_arrays([pa.array(range(256)), pa.array(range(256)), pa.array([text] * 256)], ["doc_id", "key", "text"])
    tracemalloc.start()
    rows = [len(b) for b in S._build(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows) == 1 + 8192 and peak < 100 << 20
