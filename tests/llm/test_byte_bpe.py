"""Ids and decoded bytes against the tiktoken library on whole texts, and the safe borders."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from tables import AWKWARD, SF, documents, empty, rows

from clearwright.llm import byte_bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    with open(FILE, "rb") as f:
        return byte_bpe.ByteBpe(f.read())


def test_short_spans_change_nothing(library, coder):
    rnd = random.Random(3)
    signs = ["a", "b", "Ä", "ñ", "漢", "字", "。", "1", "٣", " ", " ", "  ", "\n", "\t", "　", "'s", "'", "’ll", "!", "😀", "é", "‍", ".", "word", "İ"]
    for _ in range(400):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(200)))
        assert list(coder.encode(text, span=8)) == library.encode_ordinary(text)
        assert "".join(byte_bpe.safe_parts(text, 8)) == text


@pytest.mark.parametrize("text", ["a" * 70_000, "ab " * 40_000, "漢字" * 30_000, "!" * 70_000, "a" + " " * 5_000 + "b" + "\n" * 3_000, " " * 2_000, "x" + "　" * 2_000 + "1", "7 " * 30_000])
def test_long_texts(library, coder, text):
    ids = coder.encode(text)
    assert list(ids) == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_more_white_space_than_the_library_matches(coder):
    text = "a" + " " * 1_000_000 + "b"
    assert coder.decode(coder.encode(text)) == text.encode()


def test_bytes_are_not_repaired(coder, library):
    split = library.encode_ordinary("😀漢")[:1]
    assert coder.decode(split) == library.decode_bytes(split)


def test_rows(spark, library):
    data = [*rows(), *enumerate(AWKWARD, 500)]
    got = byte_bpe.encode_and_decode(documents(spark, data), FILE).select("doc_id", "ids", "decoded", "source", byte_bpe.n_tokens().alias("n")).collect()

    def key(i, ids, text):
        return str(i), struct.pack(f"<{len(ids)}I", *ids), text.encode(), len(ids)

    want = sorted(key(i, library.encode_ordinary(t or ""), t or "") for i, t in data)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded), r.n) for r in got) == want


def test_empty_table(spark):
    assert byte_bpe.encode_and_decode(empty(documents(spark)), FILE).collect() == []


def test_query(spark, library):
    from clearwright.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_byte_bpe_round_trip"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
