"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value significance.

Token scores.  Labelled texts give counts of each word in both classes.  Dirichlet priors are stacked: a
word's prior is the distribution of its stem (its first STEM characters, so unseen forms of a
known word are judged by their kin), the stem's prior is the pooled distribution.  The score of a
token is its posterior log-odds less CAUTION standard deviations, less a drift, so that only
tokens with evidence score above zero.

Segments.  All maximal scoring segments of a text (the parts no extension or cut can improve) are found
in one scan over the text, with runs of negative tokens folded into one step.

Significance.  The largest score of n tokens of clean text follows a Gumbel law,
P(S > s) = 1 - exp(-K n exp(-lambda s)).  K and lambda are fitted by maximum likelihood to clean
labelled texts, those without a positive token being censored at 0.  A segment is significant if
fewer than ALPHA such segments are expected in the text.  A logistic curve over the
evidence of the significant segments gives the probability.

The tables are counts in BUCKETS hash buckets, so the model has a fixed size at any vocabulary.  Fitting uses a
hash sample of at most `bound` labelled rows outside the held-out fifth.

Cases: null and empty texts have no segment and the lowest score; without labels of both classes
the score is the class rate; rows that share an id are scored apart; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from clearwright.llm.common import small_batches

WORD = re.compile(r"\w+")
STEM = 5
BUCKETS = 1 << 20
MEMO = 500_000
PRIOR = 2.0
CAUTION = 1.5
DRIFT = 0.25
STEM_WEIGHT = 20.0
ALPHA = 0.05
SAMPLE = 40_000


def _bucket(token: str) -> int:
    return xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 0) % BUCKETS


class _Buckets(dict):
    """(bucket of the word, bucket of its stem), kept for frequent words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = _bucket(word), _bucket("^" + word[:STEM])
        return value


def token_counts(sample: DataFrame) -> DataFrame:
    """(bucket, clean, toxic) counts of words and stems over (text, y), summed inside each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of = np.zeros((2, BUCKETS), dtype=np.int64), _Buckets()
        for batch in batches:
            flat: tuple[list[int], list[int]] = [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                flat[int(y > 0)].extend(chain.from_iterable(map(of.__getitem__, WORD.findall((text or "").lower()))))
            for k, found in enumerate(flat):
                at, n = np.unique(np.array(found, dtype=np.int64), return_counts=True)
                counts[k, at] += n
        at = np.nonzero(counts.any(axis=0))[0]
        for some in np.array_split(at, max(1, len(at) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0, some]), pa.array(counts[1, some])], ["bucket", "clean", "toxic"])

    return sample.select("text", "y").mapInArrow(run, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in linear time."""
    ups = np.nonzero(scores > 0)[0]
    if not len(ups):
        return []
    total = np.cumsum(scores, dtype=np.float64)
    before = (total[ups] - scores[ups]).tolist()
    after = total[ups].tolist()
    starts: list[int] = []
    ends: list[int] = []
    low: list[float] = []
    high: list[float] = []
    links: list[int] = []  # the nearest earlier candidate with a smaller left sum
    for k, (left, right) in enumerate(zip(before, after)):
        start, end = k, k
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = links[j]
            if j < 0 or high[j] >= right:
                break
            start, left = starts[j], low[j]
            del starts[j:], ends[j:], low[j:], high[j:], links[j:]
        starts.append(start), ends.append(end), low.append(left), high.append(right), links.append(j)
    return [(int(ups[s]), int(ups[e]) + 1, h - b) for s, e, b, h in zip(starts, ends, low, high)]


@dataclass
class ToxicityModel:
    """Counts per bucket (words and stems, a row per class), tokens per class, and the fitted laws."""

    counts: np.ndarray
    totals: tuple[float, float]
    gumbel_lambda: float = 1.0
    gumbel_k: float = 0.01
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    memo: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def of_word(self, word: str) -> float:
        """Posterior log-odds of a word under its stem's prior, lowered by its uncertainty and the drift."""
        clean, toxic = self.totals
        c, t = self.counts[:, _bucket(word)].tolist()
        sc, st = self.counts[:, _bucket("^" + word[:STEM])].tolist()
        weight = min(1.0, STEM_WEIGHT / (sc + st)) if sc + st else 0.0
        c += PRIOR * clean / (clean + toxic) + weight * sc
        t += PRIOR * toxic / (clean + toxic) + weight * st
        return math.log(t / toxic) - math.log(c / clean) - CAUTION * math.sqrt(1 / c + 1 / t) - DRIFT

    def scores(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if missing := set(words).difference(memo):
            if len(memo) > MEMO:
                memo.clear()
                missing = set(words)
            memo.update((w, self.of_word(w)) for w in missing)
        return np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words))

    def expected(self, score, n: int):
        """Segments of clean text of n tokens expected to score as much."""
        return self.gumbel_k * n * np.exp(-self.gumbel_lambda * score)

    def evidence(self, found: np.ndarray, n: int) -> tuple[float, int]:
        """Sum of -log(expected) over the significant segments, and their number."""
        e = self.expected(found, n)
        good = e[e < ALPHA]
        return float(-np.log(np.maximum(good, 1e-300)).sum()), len(good)

    def features(self, found: np.ndarray, n: int) -> tuple[float, float]:
        """Evidence of the whole text, and of its best segment on the same scale."""
        best = float(found.max()) if len(found) else 0.0
        return math.log1p(self.evidence(found, n)[0]), math.log1p(self.gumbel_lambda * best)

    def probability(self, found: np.ndarray, n: int) -> float:
        x = self.curve[0] + sum(w * v for w, v in zip(self.curve[1:], self.features(found, n)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))

    def scan(self, text: str | None) -> tuple[np.ndarray, int]:
        """Scores of all maximal segments, and the number of tokens."""
        words = WORD.findall((text or "").lower())
        return np.array([s for _, _, s in segments(self.scores(words))]), len(words)

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Significant passages: code point start, end, score, expected number."""
        spans = [(m.start(), m.end()) for m in WORD.finditer(text or "")]
        found = segments(self.scores([text[s:e].lower() for s, e in spans])) if spans else []
        out = [(spans[s][0], spans[e - 1][1], score, float(self.expected(score, len(spans)))) for s, e, score in found]
        return [p for p in out if p[3] < ALPHA]


def model_of_counts(buckets: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> ToxicityModel:
    counts = np.zeros((2, BUCKETS), dtype=np.float32)
    counts[0, buckets], counts[1, buckets] = clean, toxic
    # Each token counts once as a word and once as a stem.
    return ToxicityModel(counts, (max(1.0, float(clean.sum()) / 2), max(1.0, float(toxic.sum()) / 2)))


def fit_gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Maximum likelihood of (lambda, K) for largest scores of clean texts of n tokens; scores of 0 are censored."""
    keep = n > 0
    best, n = best[keep], n[keep].astype(np.float64)
    up = best > 0
    if up.sum() < 5:
        return 1.0, max(1e-6, (up.sum() + 0.5) / max(1.0, n.sum()))

    def slope(x: float) -> float:
        w = n * np.exp(-x * best)
        return up.sum() / x - best[up].sum() + up.sum() * (w * best).sum() / w.sum()

    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return low, float(up.sum() / (n * np.exp(-low * best)).sum())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve with a constant, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * len(x) * np.eye(len(w)) / 100
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * w / 100)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(sample: DataFrame) -> ToxicityModel:
    """Fit on (text, y), a bounded sample; the driver gets one row per used bucket and the segment scores of each sampled text."""
    small_batches(sample.sparkSession)
    rows = token_counts(sample).toArrow()
    model = model_of_counts(*(rows[c].to_numpy() for c in ("bucket", "clean", "toxic")))
    del rows
    shared = sample.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 * BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.scan(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([g[0].tolist() for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.int64())], ["y", "found", "n"])

    seen = sample.select("text", "y").mapInArrow(run, "y int, found array<double>, n long").toArrow()
    ordered = sorted(zip(seen["y"].to_pylist(), seen["n"].to_pylist(), seen["found"].to_pylist()))  # sums do not depend on the order of arrival
    y, n = (np.array([r[k] for r in ordered], dtype=np.float64) for k in (0, 1))
    if not 0 < y.sum() < len(y):
        rate = (y.sum() + 0.5) / (len(y) + 1)
        model.curve = (math.log(rate / (1 - rate)), 0.0, 0.0)
        return model
    found = [np.array(f, dtype=np.float64) for *_, f in ordered]
    best = np.array([f.max() if len(f) else 0.0 for f in found])
    model.gumbel_lambda, model.gumbel_k = fit_gumbel(best[y == 0], n[y == 0])
    x = np.array([model.features(f, k) for f, k in zip(found, (k for _, k, _ in ordered))])
    model.curve = tuple(fit_logistic(x, y).tolist())
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, n_passages, evidence) of every row of `docs`; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_passages int, evidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scans = [own.scan(t) for t in batch.column("text").to_pylist()]
            evidence = [own.evidence(*s) for s in scans]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([own.probability(*s) for s in scans], pa.float64()),
                pa.array([e[1] for e in evidence], pa.int32()), pa.array([e[0] for e in evidence], pa.float64()),
            ], ["doc_id", "score", "n_passages", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, passages): every significant passage as (start, end, score, expected), in code points, end exclusive."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:long,end:long,score:double,expected:double>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "score", "expected"), p)) for p in shared.value.passages(t)] for t in texts])

    return docs.select("doc_id", find("text").alias("passages"))
