"""Centroid clustering of vectors over whole numbers, with a LAESA pivot table.

Components become floor(scale * x).  A few pivots are picked once, far apart from each other, and the distance of every
vector to every pivot is stored once, next to the vector.  In each round only the centroids' distances to the pivots are
new: by the triangle inequality |d(x, p) - d(c, p)| is at most d(x, c), so the largest of these differences over the pivots
bounds every centroid from below.  The centroid with the least bound is measured first; the others are
measured, in whole numbers, only where their bound does not exceed the best distance so far.  A bound that equals the
best is measured too, so ties go to the smaller number as they should.

Rounds are jobs over the stored table.  A task returns one sum per centroid and component, Spark adds
them up, and `centroids * (dim + 1)` numbers reach the driver.  A round that moves no centroid ends the rounds: all later ones would repeat it.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out, as are those
with a scaled component of LIMIT or more, whose squared distances do not fit 64 bits; fewer vectors than
centroids give as many centroids as vectors; rows that share an id or a vector count each; null ids come last when
the first centroids are drawn; sums beyond 64 bits are null; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwright.llm.common import small_batches, written

LIMIT = 1 << 27
PIVOTS = 12
PIVOT_SAMPLE = 512
SLACK = 1e-12


def whole_vector(vector: str, dim: int, scale: int) -> Column:
    """floor(scale * x) of a sound vector, else null."""
    v = F.col(vector)
    sound = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` different vectors of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    picked = [0]
    least = _squared(sample, sample[:1])
    while len(picked) < count and least.max() > 0:
        picked.append(int(least.argmax()))
        least = np.minimum(least, _squared(sample, sample[picked[-1]][None]))
    return sample[picked]


class PivotTable:
    """Pivots, and nearest centroids by way of them."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.measured = 0

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distance of each vector to each pivot."""
        return np.sqrt(np.stack([_squared(x, p[None]) for p in self.pivots], axis=1).astype(np.float64))

    def bounds(self, to_pivots: np.ndarray, centres_to_pivots: np.ndarray) -> np.ndarray:
        """A number not above the squared distance of each vector and centroid."""
        bound = np.zeros((len(to_pivots), len(centres_to_pivots)))
        for p in range(to_pivots.shape[1]):
            a, b = to_pivots[:, p, None], centres_to_pivots[None, :, p]
            np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
        return bound * bound * (1 - SLACK)

    def nearest(self, x: np.ndarray, to_pivots: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each vector, the smaller number where distances tie."""
        bound = self.bounds(to_pivots, self.distances(centres))
        cluster = bound.argmin(axis=1)
        best = _squared(x, centres[cluster])
        first = cluster.copy()
        self.measured += len(x)
        for c in np.argsort(bound.sum(axis=0), kind="stable").tolist():
            rows = np.nonzero((bound[:, c] <= best) & (first != c))[0]
            if not len(rows):
                continue
            self.measured += len(rows)
            d = _squared(x[rows], centres[c][None])
            won = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
            best[rows[won]], cluster[rows[won]] = d[won], c
        return cluster, best


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def pivot_table(whole: DataFrame, dim: int, pivots: int) -> tuple[DataFrame, PivotTable]:
    """The stored rows (vec_id, x, near) of (vec_id, x), and their pivots."""
    drawn = whole.select("x").orderBy(F.xxhash64(F.lit("pivot"), "x"), "x").limit(PIVOT_SAMPLE).toArrow()
    table = PivotTable(far_apart(_matrix(drawn["x"].combine_chunks(), dim, np.int64), pivots))
    width = len(table.pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = table.distances(_matrix(batch.column("x"), dim, np.int64)) if width and len(batch) else np.zeros((len(batch), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "near"])

    return written(whole.mapInArrow(measure, "vec_id long, x array<int>, near array<double>"), "pivot-table"), table


def _nearest(batch: pa.RecordBatch, table: PivotTable, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = _matrix(batch.column("x"), centres.shape[1], np.int64)
    return x, *table.nearest(x, _matrix(batch.column("near"), len(table.pivots), np.float64), centres)


def _moved(stored: DataFrame, table: PivotTable, centres: np.ndarray) -> np.ndarray:
    """Centroids after one round."""
    k, dim = centres.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), dtype=np.int64)  # a count after the sums
        for batch in batches:
            if len(batch):
                x, cluster, _ = _nearest(batch, table, centres)
                for c in range(k):
                    total[c, :dim] += x[cluster == c].sum(axis=0)
                total[:, dim] += np.bincount(cluster, minlength=k)
        at, part = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(part, pa.int32()), pa.array(total[at, part])], ["cluster", "part", "total"])

    sums = np.zeros((k, dim + 1), dtype=object)
    for row in stored.mapInArrow(add, "cluster int, part int, total long").groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        sums[row.cluster, row.part] = int(row.total)
    return np.array([[s // n for s in sums[c, :dim]] if (n := sums[c, dim]) else centres[c].tolist() for c in range(k)], dtype=np.int64)


def cluster(vectors: DataFrame, centroids: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024, pivots: int = PIVOTS,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid), a row per sound vector; distances are squared.

    First centroids: the vectors with the smallest SHA-256 of `seed:vec_id`, in that order.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    whole = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole_vector(vector, dim, scale).alias("x")).filter("x is not null")
    stored, table = pivot_table(whole, dim, pivots)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = stored.select(order.alias("h"), "vec_id", "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(centroids).collect()
    centres = np.array([r.x for r in start], dtype=np.int64).reshape(-1, dim)
    for _ in range(rounds if len(centres) else 0):
        before, centres = centres, _moved(stored, table, centres)
        if np.array_equal(before, centres):
            break

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                _, at, distance = _nearest(batch, table, centres)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    placed = written(stored.mapInArrow(place, "vec_id long, cluster int, distance long"), "clusters")
    found = {r.cluster: int(r.d) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}

    def fits(n: int) -> int | None:
        return n if n < 1 << 63 else None

    ends = spark.createDataFrame(
        [(c, fits(found.get(c, 0)), fits(sum(found.values())), centres[c].tolist()) for c in range(len(centres))],
        "of int, cluster_inertia long, inertia long, centroid array<long>")
    return placed.join(F.broadcast(ends), placed.cluster == ends.of).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
