"""Near-duplicate vectors by an inverted multi-index: product grid of two codebooks, nearest cells first, exact check last.

Each half of a unit vector has a codebook of K centroids, so the grid has K * K cells.  A vector lies in the
cell of its nearest two centroids and visits cells in the order of the summed half distances (the
multi-sequence order: the pair of ranks (i, j) is among the first T only if (i + 1)(j + 1) <= T, so these pairs
are ranked).  How many cells T are visited is measured: sampled points are compared with all
other points exactly, and T is the smallest number of cells that reaches `recall` both over all their pairs and
over the mean point with a partner.  A point's match with itself and exact copies (one point) do not count.
Where QUERIES points show fewer than PARTNERED with a partner, MOST_QUERIES are compared; where these are
still too few and not all points, T must also reach `recall` for near copies made of the sampled vectors at a cosine of just
the threshold.  Visited vectors are verified by cosine in double precision, from components as precise as
given, so no pair below the threshold is linked.

Codebooks are fitted to at most SAMPLE vectors; every vector is indexed and is a query.  Equal vectors
of one label are one point with a weight.  A cell with more than BLOCK members or visitors is dealt as a grid of
member blocks by visitor blocks; blocks return link counts per point and links that join
parts, never all pairs.

Cases: vectors that are null, zero, or hold null or non-finite components, and rows without a
label, have no link and are their own component; vectors of different length never meet; copies with equal
ids stay rows of their own; a null id is ignored as a minimum; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from clearwright.llm.common import small_batches, written
from clearwright.llm.components import connected_components

THRESHOLD = 0.93
RECALL = 0.99
SAMPLE = 16_384
QUERIES = 256
MOST_QUERIES = 4096
PARTNERED = 128
NEAR_COPIES = 1024
MOST_CENTROIDS = 1024
PER_CELL = 16
BLOCK = 1024


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of tiny and huge components finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def codebook(x: np.ndarray, size: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of half vectors by Lloyd's rounds."""
    rnd = np.random.default_rng(seed)
    centres = x[rnd.choice(len(x), min(size, len(x)), replace=False)]
    for _ in range(rounds):
        near = _squares(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


class Grid:
    """The product grid of two codebooks."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.cut, self.across = first.shape[1], len(second)
        self.cells = len(first) * len(second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(x[:, :self.cut], self.first), _squares(x[:, self.cut:], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * self.across + b.argmin(axis=1)

    def nearest(self, x: np.ndarray, count: int) -> np.ndarray:
        """The first `count` cells of each vector's traversal."""
        a, b = self.distances(x)
        by_a, by_b = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        count = min(count, self.cells)
        i, j = np.array([(i, j) for i in range(min(len(self.first), count)) for j in range(min(self.across, count // (i + 1)))]).T
        sums = np.take_along_axis(a, by_a, 1)[:, i] + np.take_along_axis(b, by_b, 1)[:, j]
        pick = sums.argsort(axis=1, kind="stable")[:, :count]
        return np.take_along_axis(by_a, i[pick], 1) * self.across + np.take_along_axis(by_b, j[pick], 1)

    def ranks(self, query: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells the query visits before it has seen each of `cells`."""
        a, b = (d[0] for d in self.distances(query[None]))
        sums, order = a[cells // self.across] + b[cells % self.across], np.sort(b)
        return 1 + sum(np.searchsorted(order, sums - d - 1e-12) for d in a)


def _fit(points: DataFrame, dim: int) -> tuple[Grid, np.ndarray, list, np.ndarray, int] | None:
    """The grid; unit vectors, labels and pids of at most MOST_QUERIES sampled points; the number of points."""
    total = points.count()
    if not total:
        return None
    share = min(1.0, SAMPLE / total)
    drawn = points.filter(F.pmod(F.xxhash64(F.lit("fit"), "vector"), F.lit(1_000_003)) <= int(share * 1_000_003))
    drawn = drawn.orderBy(F.xxhash64("vector", "label")).limit(SAMPLE).select("vector", "label", "pid").toArrow()
    if not len(drawn):
        drawn = points.limit(SAMPLE).select("vector", "label", "pid").toArrow()
    x = _units(drawn["vector"].combine_chunks(), dim)
    size = min(MOST_CENTROIDS, 1 << max(1, math.ceil(math.log2(math.sqrt(total / PER_CELL) + 1))))
    grid = Grid(codebook(x[:, :dim // 2], size), codebook(x[:, dim // 2:], size, seed=6))
    return grid, x[:MOST_QUERIES], drawn["label"].to_pylist()[:MOST_QUERIES], drawn["pid"].to_numpy()[:MOST_QUERIES], total


def _pair_ranks(points: DataFrame, grid: Grid, queries: np.ndarray, labels: list, pids: np.ndarray, dim: int, threshold: float) -> pd.DataFrame:
    """(q, rank, n): how many other points within the threshold of query q lie in the cell it visits at that rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, pid = _units(batch.column("vector"), dim), batch.column("pid").to_numpy()
            own, home = np.array(batch.column("label").to_pylist(), dtype=object), grid.home(x)
            for at in range(0, len(queries), QUERIES):
                close = queries[at:at + QUERIES] @ x.T >= threshold
                for q in (np.nonzero(close.any(axis=1))[0] + at).tolist():
                    hit = np.nonzero(close[q - at] & (own == labels[q]) & (pid != pids[q]))[0]
                    if len(hit):
                        cells, n = np.unique(home[hit], return_counts=True)
                        rank = grid.ranks(queries[q], cells)
                        yield pa.RecordBatch.from_arrays([pa.array([q] * len(rank), pa.int32()), pa.array(rank, pa.int64()), pa.array(n, pa.int64())], ["q", "rank", "n"])

    return points.select("vector", "label", "pid").mapInArrow(run, "q int, rank long, n long").groupBy("q", "rank").agg(F.sum("n").alias("n")).toPandas()


def _near_copy_ranks(grid: Grid, x: np.ndarray, threshold: float) -> np.ndarray:
    """Cells visited until one of a vector and a made copy at a cosine of `threshold` sees the other."""
    turn = np.random.default_rng(11).normal(size=x.shape)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    turn /= np.maximum(np.sqrt((turn * turn).sum(axis=1, keepdims=True)), 1e-12)
    copies = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * turn
    home, home_of_copy = grid.home(x), grid.home(copies)
    return np.array([min(grid.ranks(a, h[None])[0], grid.ranks(b, g[None])[0]) for a, b, g, h in zip(x, copies, home, home_of_copy)])


def _cells_for_recall(points: DataFrame, grid: Grid, queries: np.ndarray, labels: list, pids: np.ndarray, total: int, dim: int, threshold: float, recall: float) -> int:
    """Cells to visit, from an exact comparison of the sampled queries with all other points."""
    got = _pair_ranks(points, grid, queries[:QUERIES], labels[:QUERIES], pids[:QUERIES], dim, threshold)
    if got["q"].nunique() < PARTNERED and len(queries) > QUERIES:
        more = _pair_ranks(points, grid, queries[QUERIES:], labels[QUERIES:], pids[QUERIES:], dim, threshold)
        got = pd.concat((got, more.assign(q=more["q"] + QUERIES)))
    cells = 2
    if len(got):
        got["share"] = got["n"] / got.groupby("q")["n"].transform("sum")
        by_rank = got.groupby("rank")[["n", "share"]].sum().sort_index().cumsum()
        enough = (by_rank >= recall * by_rank.iloc[-1] - 1e-9).all(axis=1)
        cells = max(cells, enough.idxmax())
    if got["q"].nunique() < PARTNERED and len(queries) < total:
        ranks = np.sort(_near_copy_ranks(grid, queries[:NEAR_COPIES], threshold))
        cells = max(cells, ranks[math.ceil(recall * len(ranks)) - 1])
    return int(min(grid.cells, cells))


def _verify(dim: int, threshold: float):
    """Per dealt cell: members first, then visitors; partial link counts and joining links."""

    def compare(m: dict, v: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
        hit = v["x"] @ m["x"].T >= threshold
        hit &= v["pid"][:, None] != m["pid"][None, :]
        vi, mi = np.nonzero(hit)
        if not len(vi):
            return [], []
        back = (m["visits"][mi] == v["home"][vi][:, None]).any(axis=1)  # the member visits the visitor's cell too
        once = ~back | (v["pid"][vi] < m["pid"][mi])
        vi, mi = vi[once], mi[once]
        if not len(vi):
            return [], []
        to_v = np.bincount(vi, weights=m["weight"][mi], minlength=len(v["pid"]))
        to_m = np.bincount(mi, weights=v["weight"][vi], minlength=len(m["pid"]))
        label = np.arange(len(m["pid"]))
        while True:  # the smallest member index that hits reach
            low = np.full(len(v["pid"]), len(label))
            np.minimum.at(low, vi, label[mi])
            new = label.copy()
            np.minimum.at(new, mi, low[vi])
            if (new == label).all():
                break
            label = new
        ups, ums = np.unique(vi), np.unique(mi)
        ids = np.concatenate((v["pid"][ups], m["pid"][ums]))
        return [ids, np.concatenate((to_v[ups], to_m[ums])).astype(np.int64)], [m["pid"][np.concatenate((low[ups], label[ums]))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, None
        block_key = ("class", "cell", "a", "b")
        for batch in batches:
            if not len(batch):
                continue
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "a", "b", "visitor", "pid", "weight", "home")}
            rows["x"] = _units(batch.column("vector"), dim)
            rows["class"] = batch.column("class").to_numpy(zero_copy_only=False)
            new = np.ones(len(batch), dtype=bool)
            new[1:] = np.any([rows[k][1:] != rows[k][:-1] for k in (*block_key, "visitor")], axis=0)
            starts = np.nonzero(new)[0].tolist()
            visits = batch.column("visits")
            counts, sources, targets = [], [], []
            for s, e in zip(starts, [*starts[1:], len(batch)]):
                here = tuple(rows[k][s] for k in block_key)
                some = {k: rows[k][s:e] for k in ("pid", "weight", "home", "x")}
                if not rows["visitor"][s]:
                    some["visits"] = visits.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                    members = some if here != key else {k: np.concatenate((members[k], some[k])) for k in some}
                    key = here
                elif here == key:
                    got, reps = compare(members, some)
                    if got:
                        sources.append(got[0]), counts.append(got[1]), targets.append(reps[0])
            if sources:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (sources, counts, targets)], ["pid", "n", "joined"])

    return run


def _links(points: DataFrame, dim: int, threshold: float, recall: float, block: int) -> DataFrame | None:
    """(pid, n, joined): partial link counts of points, and a point of the same group."""
    fitted = _fit(points, dim)
    if fitted is None:
        return None
    grid, queries, labels, pids, total = fitted
    visits = _cells_for_recall(points, grid, queries, labels, pids, total, dim, threshold, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = grid.nearest(_units(batch.column("vector"), dim), visits) if len(batch) else np.zeros((0, 1), dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "visits"])

    chosen = points.select("pid", "class", "weight", "vector")
    placed = written(chosen.mapInArrow(place, f"pid long, class long, weight long, vector {points.schema['vector'].dataType.simpleString()}, visits array<int>"), "vectors").withColumn("home", F.element_at("visits", 1))
    trips = placed.select("class", "pid", "weight", "home", "vector", F.explode("visits").alias("cell"))
    both = placed.select("class", F.col("home").alias("cell"), F.lit(1).alias("m"), F.lit(0).alias("v")).unionByName(
        trips.select("class", "cell", F.lit(0).alias("m"), F.lit(1).alias("v")))
    sums = both.groupBy(F.col("class").alias("c"), F.col("cell").alias("h")).agg(F.sum("m").alias("m"), F.sum("v").alias("v"))
    # A hot cell is a grid of member blocks by visitor blocks; each pair meets in one of them.
    hot = sums.filter((F.col("m") > block) | (F.col("v") > block)).select(
        "c", "h", *(F.greatest(F.lit(1), F.ceil(F.col(k) / block)).cast("int").alias(f"{k}_parts") for k in "mv"))
    m_parts, v_parts = (F.coalesce(f"{k}_parts", F.lit(1)) for k in "mv")
    own = F.pmod(F.xxhash64("pid"), F.col("n_own")).cast("int")
    members = placed.join(hot, (placed["class"] == hot.c) & (placed.home == hot.h), "left").withColumn("n_own", m_parts).select(
        "class", F.col("home").alias("cell"), own.alias("a"), F.explode(F.sequence(F.lit(0), v_parts - 1)).alias("b"),
        F.lit(False).alias("visitor"), "pid", "weight", "home", "vector", "visits")
    visitors = trips.join(hot, (trips["class"] == hot.c) & (trips.cell == hot.h), "left").withColumn("n_own", v_parts).select(
        "class", "cell", F.explode(F.sequence(F.lit(0), m_parts - 1)).alias("a"), own.alias("b"),
        F.lit(True).alias("visitor"), "pid", "weight", "home", "vector", F.array().cast("array<int>").alias("visits"))
    group = ["class", "cell", "a", "b"]
    dealt = members.unionByName(visitors).repartition(*group).sortWithinPartitions(*group, "visitor")
    return dealt.mapInArrow(_verify(dim, threshold), "pid long, n long, joined long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of `vectors` (vec_id, embedding, label)."""
    small_batches(vectors.sparkSession, 2048)
    one = F.col("embedding")
    sound = F.col("label").isNotNull() & one.isNotNull() & F.forall(one, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(one, lambda v: v != 0)
    kind = "array<float>" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "array<double>"
    rows = vectors.select("vec_id", F.col("label").alias("label"), F.when(F.coalesce(sound, F.lit(False)), one).cast(kind).alias("vector"))
    points = written(
        rows.filter("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
        .withColumn("class", F.xxhash64("label")).withColumn("pid", F.monotonically_increasing_id()), "points")
    sizes = [r[0] for r in points.select(F.size("vector").alias("dim")).distinct().collect()]
    found = [f for d in sizes if (f := _links(points.filter(F.size("vector") == d), d, threshold, recall, block)) is not None]
    spark = vectors.sparkSession
    links = spark.createDataFrame([], "pid long, n long, joined long")
    for f in found:
        links = links.unionByName(f)
    links = written(links, "vector-links")
    linked = connected_components(links, "pid", "joined")
    direct = links.groupBy(F.col("pid").alias("of")).agg(F.sum("n").alias("n"))
    labelled = points.join(linked, points.pid == linked.node, "left").select("label", "vector", "least", "weight", "pid", F.coalesce("component", "pid").alias("group"))
    smallest = labelled.groupBy(F.col("group").alias("g")).agg(F.min("least").alias("component"))
    classes = (
        labelled.join(smallest, labelled.group == smallest.g).join(direct, F.col("pid") == F.col("of"), "left")
        .select(F.col("label").alias("l"), F.col("vector").alias("v"), "component", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"))
    )
    joined = rows.join(classes, (rows.label == classes.l) & (rows.vector == classes.v), "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
