"""The factorisation machine against explicit pairs, and held-out accuracy."""

import numpy as np
from tables import SF, documents, empty, rows

from clearwright.llm import quality
from clearwright.llm.queries import QUERIES


def test_squares_identity_equals_all_pairs():
    rnd = np.random.default_rng(0)
    v, w = rnd.normal(size=(6, 3)), rnd.normal(size=6)
    x = rnd.normal(size=(4, 6))
    model = quality.FactorisationMachine(0.3, w, v)
    want = [0.3 + r @ w + sum(v[i] @ v[j] * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(model.logit(x), want)


def test_interactions_are_learned(monkeypatch):
    monkeypatch.setattr(quality, "WIDTH", 6)
    rnd = np.random.default_rng(1)
    x = (rnd.random((2000, 6)) < 0.5).astype(np.float32)
    y = (x[:, 0] == x[:, 1]).astype(float)
    model = quality.fit(x, y, epochs=30)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_awkward_rows(spark):
    train = spark.createDataFrame([("good text here", 1), ("BAD!! BAD!!", 0), (None, 1), ("", 0)] * 20, "text string, y int")
    model = quality.train(train)
    docs = documents(spark)
    got = quality.score(docs, model)
    assert got.columns == [*(c for c in docs.columns if c != "score"), "score"]
    scores = got.collect()
    assert len(scores) == len(rows()) and all(0 <= r.score <= 1 for r in scores)
    by_text = {}
    assert all(abs(by_text.setdefault(r.text, r.score) - r.score) < 1e-5 for r in scores)  # single precision
    assert quality.score(empty(docs), model).collect() == []
    assert {round(r.score, 6) for r in quality.score(docs, quality.train(train.limit(0))).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op6_quality_scores"](spark, sf).collect() if r.doc_id in labels and r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in got) / len(got) > 0.85
    good = [r.predicted for r in got if labels[r.doc_id]]
    assert sum(good) / len(good) > 0.95
