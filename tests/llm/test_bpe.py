"""Encoding and decoding against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tables import AWKWARD, SF, documents, empty, rows
from tokenizers import Tokenizer

from clearwright.llm import bpe

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def coder():
    with open(FILE, encoding="utf-8") as f:
        return bpe.SpeculativeBpe(f.read())


def texts():
    rnd = random.Random(2)
    letters = "abcdesthing   .,'\n\t<|é漢Σ▁01\x1ć"
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(400)]
    made += ["".join(chr(rnd.randrange(1, 0xD7FF)) for _ in range(30)) for _ in range(200)]
    return [t for t in AWKWARD if t is not None] + made + ["haha" * 300, "a" * 999, "it's WE'LL 'd", "Ⰰ՘x Ᲊ 　 y"]


def test_same_as_library(coder, library):
    for text, found in zip(texts(), coder.ids_of(texts())):
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids == found.tolist()
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_both_ways_of_encoding_are_used_and_agree(coder):
    words = "thing the strawberry ouwhea ofthstthor edoution onharent threlyes heenthrendre thatthanesble eringst".split()
    before = coder.failed
    found = coder.words(words)
    assert before < coder.failed < before + len(words)
    assert found == [coder._merged(w) for w in words]


def test_long_words_are_merged_alike(coder, monkeypatch):
    word = "antidisestablishmentarianism" * 3
    whole = coder._merged(word)
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert coder._merged(word) == whole


def test_a_small_memo_changes_nothing(coder, monkeypatch):
    want = [coder.encode(t) for t in texts()]
    monkeypatch.setattr(bpe, "MEMO", 6)
    assert [ids.tolist() for ids in coder.ids_of(texts())] == want


def test_table(spark, library):
    data = rows()
    out = bpe.encode_and_decode(documents(spark, data), FILE)
    assert out.columns.count("ids") == out.columns.count("decoded") == 1
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in data]
    want = sorted((str(i), ids, library.decode(ids, skip_special_tokens=False)) for i, ids in want)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in out.collect()) == want
    assert bpe.encode_and_decode(empty(documents(spark)), FILE).collect() == []


def test_query(spark, library):
    from hashlib import sha256

    from clearwright.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op5_bpe_round_trip"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
