"""Byte-level BPE with the tiktoken library and a local rank file; long texts are cut at borders that no match can cross.

The pattern matches runs of letters, digits or other signs, each with a space before it, contractions, and white
space.  No match holds a letter and, after it, something that is no letter, so a text may be cut there and the parts
encoded apart: the pieces, and so the ids, are those of the whole.  A part then never needs more of the
library's stack and memory than SPAN characters do, unless one match is longer.  White space is the exception, as its
runs are matched backwards: a run of RUN characters or more is one piece by the pattern's own rule (less
its last character where something follows) and goes to the library as such.

Decoding joins the bytes of the ids; they need not be UTF-8 and are not repaired.

Cases: null and empty texts have no ids and no bytes; special strings are ordinary text; rows that share an id stay
apart; an empty table gives an empty result.  Output columns replace columns of the same name.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearwright.llm.common import small_batches

SPAN = 32_768
RUN = 1_024
# White space as the pattern's \s has it (the Unicode property).  Fixed values.
WHITE = "\t-\r \x85\xa0  -     　"
# Letters in every version of Unicode, before signs that never were letters.
_BORDER = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ɏα-ωа-яא-תぁ-んァ-ヶ一-鿋가-힣])(?=[ \n\r\t.,;:!?()\"'、。，])")
_RUN = re.compile(f"[{WHITE}]{{{RUN},}}")


def safe_parts(text: str, span: int = SPAN) -> Iterator[str]:
    """The text in parts that begin and end where matches do; a part is longer than `span` only where no border is known."""
    at = 0
    while len(text) - at > span:
        border = None
        for border in _BORDER.finditer(text, at + span // 2, at + span):
            pass  # the last one in the second half of the span
        border = border or _BORDER.search(text, at + span)
        if border is None:
            break
        yield text[at:border.start()]
        at = border.start()
    yield text[at:]


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN):
        pairs = map(bytes.split, filter(None, ranks.splitlines()))
        self.library = tiktoken.Encoding(
            "local", pat_str=pattern, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs}, special_tokens={})

    def encode(self, text: str, span: int = SPAN) -> array:
        """The ids of one text."""
        ids, at = array("I"), 0
        if len(text) > RUN:
            for run in _RUN.finditer(text):
                end = run.end() - (run.end() < len(text))
                self._extend(ids, text[at:run.start()], span)
                ids.extend(self.library._encode_single_piece(text[run.start():end]))
                at = end
        self._extend(ids, text[at:] if at else text, span)
        return ids

    def _extend(self, ids: array, text: str, span: int) -> None:
        for part in safe_parts(text, span):
            ids.extend(self.library.encode_ordinary(part))

    def decode(self, ids: array) -> bytes:
        return self.library.decode_bytes(ids)


@lru_cache(maxsize=2)
def _shared(ranks: bytes) -> ByteBpe:
    """One encoder per Python worker."""
    return ByteBpe(ranks)


def encode_and_decode(docs: DataFrame, rank_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with the ids of the text, packed as little-endian unsigned 32-bit integers, and the bytes that they decode to; one pass, no shuffle."""
    small_batches(docs.sparkSession, 256)
    ranks = Path(rank_file).read_bytes()
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    given = "_text_to_encode"
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _shared(ranks)
        for batch in batches:
            coded = [coder.encode(t or "") for t in batch.column(given).to_pylist()]
            packed = pa.array([np.asarray(c).astype("<u4").tobytes() for c in coded], pa.binary())
            raw = pa.array([coder.decode(c) for c in coded], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), packed, raw], [*kept, ids, decoded])

    return docs.select(*kept, F.col(text).alias(given)).mapInArrow(run, schema)


def n_tokens(ids: str = "ids") -> Column:
    """How many ids are packed."""
    return (F.octet_length(ids) / 4).cast("long")
