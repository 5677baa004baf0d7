"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): every pair of features
interacts through `RANK` factors, and the sum-of-squares identity makes that linear in the
number of features.  Features: counts of lower-cased words in WORD_BUCKETS hash buckets (square roots,
scaled to unit length), statistics of the text's structure, and metadata of the text (its size in
one-hot octaves).  Labels, lang, source and doc_id are never read.

Fitting uses a hash sample of at most `bound` labelled rows outside the held-out fifth; their features
(fixed width) reach the driver, which runs AdaGrad over them.  Scoring is one pass without a shuffle.

Cases: null and empty texts have zero word features and the lowest octave, and get a score
from these; without labels of both classes the score is the class rate; rows that share an id
are scored apart; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from clearwright.llm.common import small_batches

WORD = re.compile(r"\w+")
WORD_BUCKETS = 2048
OCTAVES = 18
RANK = 8
SAMPLE = 24_000
EPOCHS = 12
MEMO = 500_000
STATISTICS = (
    "upper", "digit", "space", "symbol", "bang", "bar", "repeated words", "top word", "repeated neighbours",
    "line length", "repeated lines", "word length", "long words", "capitalised", "non-ascii", "sentence ends", "links", "any word",
)
WIDTH = WORD_BUCKETS + OCTAVES + len(STATISTICS)


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        bucket = self[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1) % WORD_BUCKETS
        return bucket


def statistics(text: str, words: list[str]) -> list[float]:
    """Structure of a text, each number about 0 to 1."""
    n, k = max(1, len(text)), max(1, len(words))
    letters = text.translate(_KINDS)
    upper, digit, space, lower = (letters.count(c) for c in "UDSL")
    counts = Counter(words)
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    return [
        upper / max(1, upper + lower), digit / n, space / n, max(0, n - upper - lower - digit - space) / n if text else 0.0,
        min(1.0, 20 * text.count("!") / n), min(1.0, 20 * text.count("|") / n),
        1 - len(counts) / k, max(counts.values(), default=0) / k,
        sum(map(str.__eq__, words, words[1:])) / k,
        min(1.0, n / max(1, len(filled)) / 1000), 1 - len(set(filled)) / max(1, len(filled)),
        min(1.0, sum(map(len, words)) / k / 15), sum(len(w) > 15 for w in counts) / max(1, len(counts)),
        min(1.0, upper / k), (len(text.encode("utf-8", "surrogatepass")) - len(text)) / n,
        min(1.0, 5 * text.count(".") / k), min(1.0, 10 * text.count("://") / k), float(bool(words)),
    ]


class _Kinds(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "U" if c.isupper() else "L" if c.isalpha() else "D" if c.isdigit() else "S" if c.isspace() else "."
        return kind


_KINDS = _Kinds()


def features(texts: list[str | None], of: _Buckets) -> np.ndarray:
    """A row of WIDTH numbers per text."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for row, text in zip(out, texts):
        text = text or ""
        words = WORD.findall(text.lower())
        if words:
            at = np.fromiter(map(of.__getitem__, words), dtype=np.int32, count=len(words))
            root = np.sqrt(np.bincount(at, minlength=WORD_BUCKETS))
            row[:WORD_BUCKETS] = root / np.sqrt((root * root).sum())
        row[WORD_BUCKETS + min(OCTAVES - 1, len(text).bit_length())] = 1.0
        row[WORD_BUCKETS + OCTAVES:] = statistics(text, words)
    return out


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        both = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * ((both * both) - (x * x) @ (self.factors * self.factors)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, ridge: float = 2e-5, batch: int = 64, seed: int = 3) -> FactorisationMachine:
    """AdaGrad on the logistic loss."""
    rnd = np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(WIDTH, dtype=np.float32), rnd.normal(0, 0.02, (WIDTH, RANK)).astype(np.float32))
    if not 0 < y.sum() < len(y):
        return FactorisationMachine(model.bias, model.linear, model.factors * 0)
    g0, g1, g2 = 1e-6, np.full(WIDTH, 1e-6, dtype=np.float32), np.full((WIDTH, RANK), 1e-6, dtype=np.float32)
    for _ in range(epochs):
        order = rnd.permutation(len(y))
        for at in range(0, len(y), batch):
            some = order[at:at + batch]
            xs = x[some].astype(np.float32)
            off = ((model.score(xs) - y[some]) / len(some)).astype(np.float32)
            d1 = xs.T @ off + ridge * model.linear
            both = xs @ model.factors
            d2 = xs.T @ (both * off[:, None]) - ((xs * xs).T @ off)[:, None] * model.factors + ridge * model.factors
            d0 = float(off.sum())
            g0 += d0 * d0
            g1 += d1 * d1
            g2 += d2 * d2
            model.bias -= rate * d0 / g0 ** 0.5
            model.linear -= rate * d1 / np.sqrt(g1)
            model.factors -= rate * 0.5 * d2 / np.sqrt(g2)
    return model


def train(sample: DataFrame) -> FactorisationMachine:
    """Fit on (text, y), a bounded sample: WIDTH half-precision numbers per row reach the driver."""
    small_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Buckets()
        for batch in batches:
            rows = features(batch.column("text").to_pylist(), of).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r.tobytes() for r in rows], pa.binary())], ["y", "x"])

    rows = sample.select("text", "y").mapInArrow(run, "y int, x binary").toArrow()
    ordered = sorted(zip(rows["x"].to_pylist(), rows["y"].to_pylist()))  # the model does not depend on the order of arrival
    x = np.frombuffer(b"".join(r for r, _ in ordered), dtype=np.float16).reshape(-1, WIDTH)
    return fit(x, np.array([y for _, y in ordered], dtype=np.float64))


def score(docs: DataFrame, model: FactorisationMachine, name: str = "score") -> DataFrame:
    """`docs` with the score of every row's text; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: WIDTH * (RANK + 1) numbers
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(*kept).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Buckets()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            got = np.concatenate([np.zeros(0)] + [shared.value.score(features(texts[i:i + 256], of)) for i in range(0, len(texts), 256)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got, pa.float64())], [*kept, name])

    return docs.select(docs["text"].alias("text_to_score"), *kept).mapInArrow(run, schema)
