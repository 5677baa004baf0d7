"""The pipeline's stages one by one on what the stage before kept, against brute-force versions."""

import os

import test_decontaminate
import test_pii
import test_shingle_sets
from tables import CLASHING, SF, documents, empty
from tokenizers import Tokenizer

import corpus_pipeline as P
from clearwright.llm import quality
from clearwright.llm.common import labelled_sample


def test_names_and_order():
    assert [f.__name__ for _, f in P.STAGES] == ["good_quality", "one_of_each_group", "without_benchmark", "without_personal_data", "encoded"]


def test_every_stage(spark, tmp_path):
    docs = given = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.read.parquet(str(tmp_path / name))
        rows.append((before, docs.collect()))
        if name != "bpe":
            assert docs.columns == given.columns

    before, after = rows[0]
    model = quality.train(labelled_sample(given, labels, "quality", quality.SAMPLE))
    scores = {r.doc_id: r.score for r in quality.score(given, model).collect()}
    assert sorted(r.doc_id for r in after) == sorted(i for i in before if scores[i] >= P.KEEP_FROM)

    before, after = rows[1]
    ids = sorted(before)
    root = test_shingle_sets.stage_groups([before[i] for i in ids], P.SIMILARITY)
    assert sorted(r.doc_id for r in after) == sorted(min(i for i, q in zip(ids, root) if q == r) for r in set(root))

    before, after = rows[2]
    judged = test_decontaminate.brute(list(before.items()), [(r.item_id, r.text) for r in items.collect()])
    assert sorted(str(r.doc_id) for r in after) == sorted(r[0] for r in judged if not r[4])

    before, after = rows[3]
    assert len(after) == len(before)
    for r in after:
        spans = test_pii.brute(before[r.doc_id])
        assert r.n_chars == len(r.text)
        assert spans or r.text == before[r.doc_id]
        assert not [s for s in test_pii.brute(r.text) if s[3] == "email"]

    before, after = rows[4]
    library = Tokenizer.from_file(P.public_tokenizers.path("word_bpe_49k.json"))
    for r in after:
        want = library.encode(before[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == library.decode(want, skip_special_tokens=False)


def test_awkward_and_empty_documents(spark):
    for name, stage in P.STAGES:
        docs = documents(spark)
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count(), name
        if name != "bpe":
            assert out.columns == docs.columns and set(CLASHING) <= set(out.columns)
        assert stage(spark, empty(docs), SF).count() == 0


def test_run(spark):
    got = P.run(spark, SF)
    assert got.count() > 50 and got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]
    assert os.path.exists(f"{SF}/documents.parquet")
