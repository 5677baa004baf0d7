"""Segments against brute force, fitted laws against simulation, scores on held-out rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F
from tables import SF, documents, empty, rows

from clearwright.llm import toxicity
from clearwright.llm.common import held_out, labelled_sample
from clearwright.llm.queries import QUERIES


def brute_segments(scores, offset=0):
    """The definition: take the highest-scoring part (the shortest, leftmost), then the same to its left and right."""
    best = None
    for s in range(len(scores)):
        for e in range(s + 1, len(scores) + 1):
            total = sum(scores[s:e])
            if total > 0 and (best is None or total > best[2] + 1e-9 or (abs(total - best[2]) <= 1e-9 and e - s < best[1] - best[0])):
                best = (s, e, total)
    if best is None:
        return []
    s, e, total = best
    return [*brute_segments(scores[:s], offset), (s + offset, e + offset, total), *brute_segments(scores[e:], offset + e)]


def test_segments_are_all_maximal_ones():
    rnd = random.Random(3)
    for _ in range(200):
        scores = [round(rnd.uniform(-3, 2), 3) for _ in range(rnd.randrange(25))]
        got = toxicity.segments(np.array(scores, dtype=float))
        want = brute_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_gumbel_fit_recovers_its_law():
    rnd = np.random.default_rng(1)
    n = rnd.integers(50, 5000, 20_000)
    best = (np.log(0.02 * n) - np.log(-np.log(rnd.random(len(n))))) / 1.7
    lam, k = toxicity.fit_gumbel(np.maximum(best, 0), n)
    assert abs(lam - 1.7) < 0.05 and abs(math.log(k / 0.02)) < 0.1


def toy(spark):
    rnd = random.Random(4)
    data = []
    for i in range(400):
        words = [f"w{rnd.randrange(80)}" for _ in range(rnd.randrange(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            at = rnd.randrange(len(words))
            words[at:at] = [f"nasty{rnd.choice('abcdef')}" for _ in range(3)]
        data.append((" ".join(words), int(toxic)))
    return spark.createDataFrame(data, "text string, y int")


def test_passages_are_found_by_unseen_forms(spark):
    model = toxicity.train(toy(spark))
    text = "w1 w2 w3 nastyq NASTYzz w4 w5 w6 w7"
    (start, end, score, expected), = model.passages(text)
    assert text[start:end] == "nastyq NASTYzz" and score > 0 and expected < toxicity.ALPHA
    assert model.passages("w1 w2 w3 w4") == model.passages(None) == model.passages("") == []
    docs = documents(spark, [(1, text), (2, None), (3, "w1")])
    found = {r.doc_id: r.passages for r in toxicity.passages(docs, model).collect()}
    assert [(p.start, p.end) for p in found[1]] == [(start, end)] and found[2] == found[3] == []
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert scores[1] > 0.5 > scores[2] == scores[3] >= 0


def test_awkward_rows_and_missing_labels(spark):
    model = toxicity.train(toy(spark))
    got = toxicity.score(documents(spark), model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty(documents(spark)), model).collect() == []
    none = toxicity.train(toy(spark).limit(0))
    assert {r.score for r in toxicity.score(documents(spark), none).collect()} == {0.5}
    assert toxicity.train(toy(spark).filter("y = 0")).probability(np.zeros(0), 0) < 0.05


def test_labels_of_the_held_out_fifth_are_not_read(spark):
    import zlib

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    used = labelled_sample(docs.select("doc_id", docs.doc_id.cast("string").alias("text")), labels, "toxic", 10**6)
    ids = sorted(int(r.text) for r in used.collect())
    assert ids == sorted(r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5)
    few = labelled_sample(docs, labels, "toxic", 50).count()
    assert 20 < few < 90
    again = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat("text", F.lit("!")))).unionByName(docs.withColumn("text", F.lit(None)))
    once, often = (labelled_sample(d, labels, "toxic", 50) for d in (docs, again))
    assert often.count() == few  # repeats of an id add no rows
    assert once.agg(F.sum("y")).first() == often.agg(F.sum("y")).first()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in spark.range(100).select("id", held_out("id").alias("h")).collect())


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")  # the smaller tables have some forty toxic rows to learn from
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op3_toxic_passages"](spark, sf).collect() if r.doc_id in labels]
    right = [r.predicted == labels[r.doc_id] for r in got if r.held_out]
    assert sum(right) / len(right) > 0.95
    caught = [r.predicted for r in got if r.held_out and labels[r.doc_id]]
    assert sum(caught) / len(caught) > 0.8
