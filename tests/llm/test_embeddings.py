"""Links and groups against all pairs."""

import numpy as np
import pytest
from tables import SF

from clearwright.llm import embeddings
from clearwright.llm.queries import QUERIES


def brute(rows, threshold=0.93):
    """vec position -> (links, component) by all pairs; and the number of linked pairs."""
    def unit(e):
        if e is None or any(v is None or not np.isfinite(v) for v in e) or not any(e):
            return None
        x = np.array(e, dtype=np.float64)
        return x / np.linalg.norm(x)

    units = [unit(e) for _, e, _ in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), v), v)
    return [(v, links[i], least[find(i)]) for i, (v, _, _) in enumerate(rows)]


def fixture(dim=12):
    rnd = np.random.default_rng(2)
    out = []
    for c in range(25):
        centre = rnd.normal(size=dim)
        for _ in range(10):
            out.append([float(np.float32(x)) for x in centre + rnd.normal(size=dim) * rnd.choice([0.02, 0.2, 0.5])])
    rows = [(i, e, i % 2) for i, e in enumerate(out)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] + [1.0] * (dim - 1), 1), (n + 3, [None] + [1.0] * (dim - 1), 0), (n + 4, out[0], None),
             (n + 5, out[0], 0), (n + 6, out[0], 0), (n + 7, [2 * x for x in out[0]], 0), (n + 8, out[0][:5], 0), (n + 9, out[0][:5], 0), (n + 10, [float("inf")] * dim, 0), (n + 11, [], 0)]
    return rows


@pytest.mark.parametrize("block", [3, 2048])
def test_all_links_are_found_with_full_recall(spark, block):
    rows = fixture()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, pid string")
    got = embeddings.near_duplicates(df, recall=1.0, block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_components_beyond_single_precision_decide(spark):
    angle = np.arccos(0.93)
    near, far = ([float(np.cos(a)), float(np.sin(a))] for a in (angle - 1e-9, angle + 1e-9))
    assert np.float32(near).tolist() == np.float32(far).tolist()
    rows = [(0, [1.0, 0.0], 0), (1, near, 0), (2, [1.0, 0.0], 1), (3, far, 1), (4, [1e300, 1e-300], 2), (5, [1e300, 0.0], 2)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=1.0).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows[:4]) + [(4, 1, 4), (5, 1, 4)]


def test_nearest_cells_are_the_traversal():
    rnd = np.random.default_rng(3)
    grid = embeddings.Grid(rnd.normal(size=(6, 4)), rnd.normal(size=(5, 3)))
    x = rnd.normal(size=(20, 7))
    a, b = grid.distances(x)
    whole = (a[:, :, None] + b[:, None, :]).reshape(20, -1).argsort(axis=1)
    for count in (1, 2, 7, 30, 99):
        assert (grid.nearest(x, count) == whole[:, :count]).all()
    assert (grid.home(x) == whole[:, 0]).all()
    assert [grid.ranks(x[0], whole[0, [k]])[0] for k in range(30)] == list(range(1, 31))


def test_recall_and_exactness(spark):
    """Random vectors of the given table, and noisy copies of some of them around the threshold."""
    table = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    rnd = np.random.default_rng(7)
    for i in rnd.choice(len(rows), 500, replace=False).tolist():
        x = np.array(rows[i][1])
        noise = rnd.normal(size=len(x))
        noise *= np.linalg.norm(x) / np.linalg.norm(noise) * rnd.uniform(0.05, 0.5)
        rows.append((len(rows) + 10**6, [float(np.float32(v)) for v in x + noise], rows[i][2]))
    want = exact(rows)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got.keys() == want.keys() and all(got[v] <= want[v] for v in want)
    assert sum(got.values()) >= 0.95 * sum(want.values()) > 500


def test_query(spark):
    got = QUERIES["op9_embedding_near_duplicates"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]


def exact(rows):
    x = np.array([e for _, e, _ in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([v for _, _, v in rows])
    return {rows[i][0]: int(((x @ x[i] >= 0.93) & (label == label[i])).sum()) - 1 for i in range(len(rows))}


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).collect() == []


@pytest.mark.parametrize("most", [4096, 256])
def test_recall_where_few_rows_have_a_partner_on_a_fine_grid(spark, monkeypatch, most):
    """One noisy copy for 1 % of the rows, and one vector with many exact copies; measured on all points and on made near copies."""
    monkeypatch.setattr(embeddings, "PER_CELL", 0.5)
    monkeypatch.setattr(embeddings, "MOST_QUERIES", most)
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(4000, 64))
    noise = rnd.normal(size=(40, 64))
    noise *= (np.linalg.norm(x[:40], axis=1) / np.linalg.norm(noise, axis=1) * rnd.uniform(0.3, 0.38, 40))[:, None]
    vectors = np.concatenate((x, x[:40] + noise)).astype(np.float32).tolist()
    rows = [(i, v, 0) for i, v in enumerate(vectors + [vectors[-1]] * 3 + [vectors[2000]] * 3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = exact(rows)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table).collect()}
    few = [v for v in want if 0 < want[v] < 10]
    assert len(few) > 70 and sum(got[v] for v in few) >= 0.97 * sum(want[v] for v in few)
