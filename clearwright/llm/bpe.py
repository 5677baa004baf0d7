"""BPE encoding by speculation: greedy longest matches are proposed, checked pair by pair, and only failures are merged exactly.

A token sequence is the BPE encoding of a word if each token is the encoding of itself and no merge
can ever cross the border of two neighbours.  Just before the merge of rank r, what touches the border are
the parts of either token that exist by then: a path down the right edge of the left
token's merge tree and one down the left edge of the right token's.  A merge of two such parts
crosses the border if its rank is below the rank that consumes the left part, and not above the
rank that consumes the right one (equal ranks are applied from the left).  All pairs of edge
nodes are looked up as vectors; verdicts are kept per distinct pair.

Texts are cut at white space first: no pre-token spans it, so encodings are kept per chunk.
Special strings in a text become their special tokens.  Decoding joins token strings by one space, as the tokenizer
file has no decoder.

Cases: null and empty texts give no ids and an empty text; words of any length are merged with a heap;
rows that share an id stay apart; an empty table gives an empty result.  Output columns replace
columns of the same name.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from clearwright.llm.common import small_batches

MEMO = 1_200_000
SHORT = 48
NO_MERGE = 1 << 62
NEVER = np.iinfo(np.int64).max
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")


def byte_letters() -> list[str]:
    """Printable stand-ins for the 256 bytes: visible Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class SpeculativeBpe:
    """Encoder and decoder for a `tokenizers` file: byte-level BPE with word ends, split by one pattern."""

    def __init__(self, source: str):
        spec, model = json.loads(source), json.loads(source)["model"]
        if model["type"] != "BPE" or spec["decoder"] or spec["post_processor"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError("a plain BPE model without decoder and post-processor is needed")
        library = Tokenizer.from_str(source)
        self.normalize, self.presplit = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.end, self.ids = model["end_of_word_suffix"] or "", model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.strings = {i: t for t, i in (self.ids | self.special).items()}
        self._merge_tables([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]])
        self.inner = {t: i for t, i in self.ids.items() if self.sound[i] and not (self.end and t.endswith(self.end))}
        self.final = {t[:len(t) - len(self.end)]: i for t, i in self.ids.items() if self.sound[i] and t.endswith(self.end)}
        self.longest = max(map(len, self.ids))
        self.reach: dict[str, int] = {}  # longest inner token by its first two letters
        for t in self.inner:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.known: set[int] = set()  # token pairs that were checked
        self.bad: set[int] = set()  # those whose border a merge can cross
        self.dtype = np.dtype(np.uint16 if max(self.strings) < 65536 else np.uint32)
        self.memo: dict[str, bytes] = {}  # ids of a chunk, packed
        self.failed = self.proposed = 0

    def _merge_tables(self, merges: list[tuple[int, int, int]]) -> None:
        size = max(self.ids.values()) + 1
        self.rank = {(a, b): (r, made) for r, (a, b, made) in enumerate(merges)}
        self.coded = {pair: r << 20 | made for pair, (r, made) in self.rank.items()}
        born, left, right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        for r, (a, b, made) in enumerate(merges):
            if born[made] < 0:
                born[made], left[made], right[made] = r, a, b
        pairs = np.array([a * 65536 + b for a, b, _ in merges])
        order = np.argsort(pairs)
        self.pair_keys, self.pair_ranks = pairs[order], order

        def edge(child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nodes, limits = [np.arange(size)], [np.full(size, NEVER)]
            while (nodes[-1] >= 0).any():
                at = nodes[-1]
                nodes.append(np.where(at >= 0, child[at], -1))
                limits.append(np.where(at >= 0, born[at], -1))
            return np.array(nodes[:-1]), np.array(limits[:-1])

        self.right_edge, self.right_limit = edge(right)
        self.left_edge, self.left_limit = edge(left)
        self.sound = np.ones(size, dtype=bool)
        compound = np.nonzero(born >= 0)[0]
        fits = ~self._crossed(left[compound], right[compound], skip_top=True)
        for token, fit in sorted(zip(compound.tolist(), fits.tolist()), key=lambda x: born[x[0]]):
            self.sound[token] = fit and self.sound[left[token]] and self.sound[right[token]]

    def _crossed(self, a: np.ndarray, b: np.ndarray, skip_top: bool = False) -> np.ndarray:
        """Whether a merge crosses the border of the tokens a and b, for many pairs at once."""
        bad = np.zeros(len(a), dtype=bool)
        for i in range(len(self.right_edge)):
            rows = np.nonzero(~bad & (self.right_edge[i][a] >= 0))[0]
            for j in range(len(self.left_edge)):
                rows = rows[self.left_edge[j][b[rows]] >= 0]
                if not len(rows):
                    break
                if skip_top and i == j == 0:
                    continue
                keys = self.right_edge[i][a[rows]] * 65536 + self.left_edge[j][b[rows]]
                at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
                ranks = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)
                bad[rows] |= (ranks < self.right_limit[i][a[rows]]) & (ranks < NEVER) & (ranks <= self.left_limit[j][b[rows]])
        return bad

    def _greedy(self, word: str) -> list[int] | None:
        out, at, n = [], 0, len(word)
        while at < n:
            rest = n - at
            if rest <= self.longest and (i := self.final.get(word[at:] if at else word)) is not None:
                out.append(i)
                return out
            for size in range(min(rest - 1, self.reach.get(word[at:at + 2], 1)), 0, -1):
                if (i := self.inner.get(word[at:at + size])) is not None:
                    out.append(i)
                    at += size
                    break
            else:
                return None
        return out

    def _merged(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, from the left among equals."""
        ids = [*map(self.ids.__getitem__, word[:-1]), self.ids[word[-1] + self.end]]
        if len(ids) <= SHORT:
            code = self.coded.get
            codes = [code(p, NO_MERGE) for p in pairwise(ids)]
            while codes and (best := min(codes)) != NO_MERGE:
                at = codes.index(best)
                ids[at:at + 2] = (best & 0xFFFFF,)
                del codes[at]
                if at:
                    codes[at - 1] = code((ids[at - 1], ids[at]), NO_MERGE)
                if at < len(codes):
                    codes[at] = code((ids[at], ids[at + 1]), NO_MERGE)
            return ids
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(self.rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = self.rank[pair][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (new := (ids[p], ids[q])) in self.rank:
                    heapq.heappush(heap, (self.rank[new][0], p, new))
        return [i for i in ids if i >= 0]

    def words(self, words: list[str]) -> list[list[int]]:
        """Encodings of words in byte letters: speculate, verify, mend."""
        guesses = [self._greedy(w) for w in words]
        pairs = [[a << 20 | b for a, b in pairwise(g)] if g else () for g in guesses]
        new = set().union(*pairs) - self.known
        if len(self.known) > 4 * MEMO:
            self.known.clear(), self.bad.clear()
            new = set().union(*pairs)
        if new:
            keys = np.fromiter(new, dtype=np.int64, count=len(new))
            self.known |= new
            self.bad.update(keys[self._crossed(keys >> 20, keys & 0xFFFFF)].tolist())
        out, fits = [], self.bad.isdisjoint
        self.proposed += len(words)
        for word, guess, own in zip(words, guesses, pairs):
            if guess is None or not fits(own):
                self.failed += 1
                guess = self._merged(word)
            out.append(guess)
        return out

    def _pre_tokens(self, chunk: str) -> list[str]:
        if chunk.isascii() or (max(chunk) < "ɐ" and "İ" not in chunk):  # both libraries know these characters, and none is composed
            chunk = chunk.lower()
            found = [chunk] if chunk.isalpha() else self.pattern.findall(chunk)
            return [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters) for w in found]
        return [w for w, _ in self.presplit(self.normalize(chunk))]

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not kept yet."""
        if len(self.memo) + len(chunks) > MEMO:
            self.memo.clear()
        chunks = list(chunks)
        split = [self._pre_tokens(c) for c in chunks]
        distinct = list(set(chain.from_iterable(split)))
        code = "H" if self.dtype.itemsize == 2 else "I"
        found = {w: array(code, ids).tobytes() for w, ids in zip(distinct, self.words(distinct))}
        self.memo.update((c, found[w[0]] if len(w) == 1 else b"".join(map(found.__getitem__, w))) for c, w in zip(chunks, split))

    def _chunks(self, text: str) -> list[str]:
        return [c for c in _SPACE.split(text) if c] if _ODD_SPACE.search(text) else text.split()

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text.

        New chunks of many texts are encoded together; more than MEMO / 2 chunks are taken in parts.
        """
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            wanted = set().union(*(some for _, some in held))
            if missing := wanted.difference(self.memo):
                kept = len(self.memo)
                self.learn(missing)
                if len(self.memo) < kept + len(missing):  # the memo was emptied
                    self.learn(wanted.difference(self.memo))
            for i, some in held:
                out[i].append(b"".join(map(self.memo.__getitem__, some)))
            held.clear()

        for i, text in enumerate(texts):
            for part in self.cut.split(text) if self.cut and self.cut.search(text) else [text]:
                if part in self.special:
                    flush()
                    out[i].append(np.array([self.special[part]], dtype=self.dtype).tobytes())
                    size = 0
                elif part:
                    chunks = self._chunks(part)
                    for at in range(0, len(chunks), MEMO // 2):
                        held.append((i, chunks[at:at + MEMO // 2]))
                        size += len(held[-1][1])
                        if size >= MEMO // 2:
                            flush()
                            size = 0
        flush()
        return [np.frombuffer(b"".join(parts), dtype=self.dtype).astype(np.int32) for parts in out]

    def encode(self, text: str) -> list[int]:
        return self.ids_of([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=1)
def _coder(source: str) -> SpeculativeBpe:
    """One encoder per Python worker, so that tasks share what it has learned."""
    return SpeculativeBpe(source)


def encode_and_decode(docs: DataFrame, tokenizer_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with the token ids of the text and the text decoded from them; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    source = Path(tokenizer_file).read_text(encoding="utf-8")
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    given = "_text_to_encode"
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(source)
        for batch in batches:
            flat = coder.ids_of([t or "" for t in batch.column(given).to_pylist()])
            texts = [coder.decode(i.tolist()) for i in flat]
            ends = np.cumsum([0, *map(len, flat)])
            values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists, pa.array(texts, pa.string())], [*kept, ids, decoded])

    return docs.select(*kept, F.col(text).alias(given)).mapInArrow(run, schema)
