"""Phrase matches against a scan of every window over every text."""

import hashlib
import random
import re

import pytest
from tables import AWKWARD, SF, documents, empty

from clearwright.llm import decontaminate as D
from clearwright.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[s:s + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s:s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[key]
        names = sorted(str(i) for i in found if i is not None)
        out.append((str(doc), len(w), len(hit), names, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def fixture():
    rnd = random.Random(8)
    some = ["the", "of", "Über", "école", "x1", *(f"w{i}" for i in range(25))]
    passage = [" ".join(rnd.choice(some) for _ in range(rnd.choice((3, 12, 13, 14, 40)))) for _ in range(25)]
    items = [(i, p) for i, p in enumerate(passage)] + [(90, passage[3]), (91, None), (92, " .,"), (None, passage[5]), (93, "the the the the"), (90, passage[7])]
    docs = []
    for i in range(60):
        filler = [rnd.choice(some) for _ in range(rnd.randrange(0, 200))]
        at = rnd.randrange(len(filler) + 1)
        own = rnd.choice(passage).split()
        cut = own[rnd.randrange(3):] if i % 3 else own
        text = " ".join(filler[:at]) + rnd.choice([", ", "\n", " - "]) + " ".join(c.upper() if i % 4 == 0 else c for c in cut) + "; " + " ".join(filler[at:])
        docs.append((i, text))
    docs += [(100 + i, t) for i, t in enumerate(AWKWARD)] + [docs[0], (1, "the the the the the"), (None, passage[4]), (200, "  ." + passage[6]), (201, passage[6] + " ")]
    return docs, items


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect())


@pytest.mark.parametrize("lists", [1, 3])
def test_contamination(spark, lists, monkeypatch):
    monkeypatch.setattr(D, "LISTS", lists)
    docs, items = fixture()
    got = D.contamination(documents(spark, docs), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"))
    assert result(got) == brute(docs, items)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    docs, items = fixture()
    assert result(D.contamination(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = documents(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contamination(empty(docs), items).collect() == []
    assert all(r.n_hit == 0 and not r.contaminated for r in D.contamination(docs, empty(items)).collect())


def test_clean_rows_stay(spark):
    docs, items = fixture()
    given = documents(spark, docs)
    kept = D.remove_contaminated(given, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == given.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(r[0] for r in brute(docs, items) if not r[4])


def brute_proximity(docs, items, slop, need, size=13):
    """(doc, window, start, met) for every occurrence of a window's rarest term."""
    counts = {}
    for _, text in docs:
        for w in words(text):
            counts[w] = counts.get(w, 0) + 1
    windows = {tuple(w[s:s + size]) for _, t in items if (w := words(t)) for s in range(max(1, len(w) - size + 1))}
    out = set()
    for window in windows:
        lead = min(window, key=lambda t: (counts.get(t, 0), window.index(t)))
        if not counts.get(lead):
            continue
        for doc, text in docs:
            w = words(text)
            for p in (k for k, x in enumerate(w) if x == lead):
                start = p - window.index(lead)
                met = {t for k, t in enumerate(window) if t in w[max(0, start + k - slop):max(0, start + k + slop + 1)]}
                if len(met) >= need * len(set(window)) - 1e-9:
                    out.add((str(doc), " ".join(window), start, len(met)))
    return out


@pytest.mark.parametrize("slop,need,lists", [(0, 1.0, 3), (2, 1.0, 1), (3, 0.6, 3)])
def test_proximity_over_all_terms(spark, monkeypatch, slop, need, lists):
    """Terms above the bound of the exact plan's lists count like others."""
    monkeypatch.setattr(D, "SHORT_LIST", 1)
    monkeypatch.setattr(D, "LONGER", 1)
    monkeypatch.setattr(D, "LISTS", lists)
    docs, items = fixture()
    _, phrases, plans, index = D.prepare(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), slop=slop)
    found = D.proximity_matches(index, plans, phrases, slop, need).join(phrases, "wid").collect()
    want = brute_proximity(docs, items, slop, need)
    assert {(str(r.doc_id), r.phrase, r.start, r.met) for r in found} == want and want


def test_proximity(spark):
    text = "zero alpha one two beta three gamma four"
    docs = documents(spark, [(1, text), (2, "alpha x x x x x x beta gamma"), (3, "gamma beta alpha")])
    items = spark.createDataFrame([(5, "alpha beta gamma")], "item_id long, text string")
    near = {}
    for slop in (0, 1, 2, 3):
        _, phrases, plans, index = D.prepare(docs, items, slop=slop)
        near[slop] = {(r.doc_id, r.start) for r in D.proximity_matches(index, plans, phrases, slop).collect()}
    assert near == {0: set(), 1: set(), 2: set(), 3: {(1, 1)}}


def test_a_window_of_one_word_stores_no_neighbours(spark):
    docs = documents(spark, [(1, "a b word c d"), (2, "word")])
    _, _, _, index = D.prepare(docs, spark.createDataFrame([(5, "word")], "item_id long, text string"))
    assert {r.near for r in index.collect()} == {"word"}


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, n, h, i, c in brute(docs, items)]
    got = QUERIES["op7_benchmark_contamination"](spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert any(w[5] for w in want)
