"""Clusters against a plain whole-number version, and what the pivots save."""

import hashlib
import math
import random

import numpy as np
from tables import SF

from clearwright.llm import laesa


def brute(rows, k=8, rounds=10, seed=3, dim=64, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for c in range(len(centres)):
            own = [v for (_, v), a in zip(kept, at) if a == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    placed = [(i, *reversed(nearest(v))) for i, v in kept]
    return [(i, c, d, sum(e for _, b, e in placed if b == c), sum(e for *_, e in placed), tuple(centres[c])) for i, c, d in placed]


def result(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, near string, cluster int")


def vectors(n=120, dim=64, seed=2):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(10)]
    return [(i, [float(np.float32(m + rnd.gauss(0, 0.1))) for m in rnd.choice(middles)]) for i in range(n)]


def test_awkward_rows(spark):
    rows = vectors()
    inf, nan = float("inf"), float("nan")
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 63 + [None]), (204, [1.0] * 63 + [nan]), (205, [-inf] + [0.0] * 63),
             (206, [0.0] * 64), (3, rows[3][1]), (4, rows[5][1]), (None, rows[6][1]), (207, [-1e-9] * 64), (208, [-3.5] * 64)]
    assert result(laesa.cluster(frame(spark, rows))) == sorted(brute(rows), key=repr)


def test_beyond_64_bits_is_left_out(spark):
    rows = [*vectors(20), (99, [1e30] * 64)]
    assert 99 not in {r[0] for r in result(laesa.cluster(frame(spark, rows)))}


def test_ties_copies_and_few_vectors(spark):
    for rows in ([(i, [float(i % 3)] * 64) for i in range(30)], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(12)]):
        assert result(laesa.cluster(frame(spark, rows))) == sorted(brute(rows), key=repr)


def test_empty_table(spark):
    assert laesa.cluster(frame(spark, [])).collect() == []
    assert laesa.cluster(frame(spark, [(1, None)])).collect() == []


def test_other_sizes(spark):
    rows = [(i, v[:5]) for i, v in vectors(60, dim=64, seed=4)]
    got = laesa.cluster(frame(spark, rows), centroids=3, rounds=4, seed=9, dim=5, scale=100, pivots=2)
    assert result(got) == sorted(brute(rows, 3, 4, 9, 5, 100), key=repr)


def test_pivots_spare_distances():
    x = np.array([[math.floor(1024 * a) for a in v] for _, v in vectors(2000)], dtype=np.int64)
    table = laesa.PivotTable(laesa.far_apart(x, laesa.PIVOTS))
    centres = table.pivots[:8]
    at, best = table.nearest(x, table.distances(x), centres)
    full = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (at == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert (table.bounds(table.distances(x), table.distances(centres)) <= full).all()
    assert table.measured < full.size * 0.7


def test_query(spark):
    from clearwright.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_laesa_clusters"](spark, SF).collect())
    want = sorted((i, c, d, own, total, hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for i, c, d, own, total, centre in brute(rows))
    assert got == want
