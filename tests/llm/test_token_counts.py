"""Counts against the sentencepiece library, and what the cache stores."""

import public_tokenizers
import sentencepiece
from tables import AWKWARD, SF, documents, empty, rows

from clearwright.llm import token_counts
from clearwright.llm.common import shared_folder

FILE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [t for t in AWKWARD if t is not None] + ["  a  b ", "a ", " a", "a▁b ▁", "<s> </s> <unk>", "   ", "\n", "a\n b\n\n c  "]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def test_chunks_add_up(monkeypatch):
    with open(FILE, "rb") as f:
        counter = token_counts.Counter(f.read())
    assert counter.splits
    want = [len(library().encode(t)) for t in TEXTS]
    assert counter.counts(TEXTS) == want
    monkeypatch.setattr(token_counts, "MEMO", 4)
    assert counter.counts(TEXTS) == want
    counter.splits = False
    assert counter.counts(TEXTS) == want


def test_counts_and_cache(spark):
    data, cache = rows(), shared_folder(spark, "cache")
    got = token_counts.count_tokens(documents(spark, data), cache, FILE, limit=50).collect()
    sp = library()
    want = sorted((str(i), len((t or "").encode()), n := len(sp.encode(t or "")), n > 50) for i, t in data)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    stored = token_counts.read_cache(documents(spark), cache, token_counts.version_of(FILE))
    assert stored.count() == stored.select("digest").distinct().count() == len({(t or "").replace("▁", " ") for _, t in data})


def test_only_misses_are_encoded(spark):
    cache = shared_folder(spark, "cache")

    def refuse(model):
        def counts(texts):
            assert set(texts) <= {"quite new"}, texts
            return [7] * len(texts)
        return counts

    docs = documents(spark)
    token_counts.count_tokens(docs, cache, FILE)
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, "quite new"), (901, "quite new")], "doc_id long, text string"))
    got = token_counts.count_tokens(more, cache, FILE, make=refuse).filter("doc_id >= 900").collect()
    assert [r.n_tokens for r in got] == [7, 7]
    stored = token_counts.read_cache(docs, cache, token_counts.version_of(FILE))
    assert stored.count() == stored.select("digest").distinct().count()


def test_empty_table(spark):
    assert token_counts.count_tokens(empty(documents(spark)), shared_folder(spark, "cache"), FILE).collect() == []


def test_query(spark):
    from clearwright.llm.queries import QUERIES

    sp = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op4_token_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    assert all(r.n_tokens == len(sp.encode(texts[r.doc_id])) and r.n_bytes == len(texts[r.doc_id].encode()) for r in got)
