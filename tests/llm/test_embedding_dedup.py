import numpy as np
import pytest

from reefline.llm.embedding_dedup import Pivots, near_vectors


def brute(rows, cosine=0.93):
    ok = {}
    for i, (_, v, label) in enumerate(rows):
        if label is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = np.array(v, dtype=float) / np.linalg.norm(v)
    part, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    order = sorted(ok, key=lambda i: rows[i][0])
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                if rows[a][0] > rows[b][0]:
                    a, b = b, a
                part[b] = a
    return {r[0]: (n[i], rows[find(i)][0]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("kw", [{}, {"cell_rows": 20, "block_rows": 16}, {"cell_rows": 4, "block_rows": 16}])
def test_equals_brute_force(spark, kw, monkeypatch):
    monkeypatch.setattr("reefline.llm.embedding_dedup.Pivots.of", staticmethod(lambda x, n, of=Pivots.of: of(x, n, 6)))
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(160):
        v = base[i % 12] + rng.normal(scale=0.18, size=8) * (i % 5)
        rows.append((1000 - i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(1, rows[0][1], 0), (2, rows[0][1], 0), (3, None, 0), (4, [0.0] * 8, 0), (5, [float("nan"), 1.0], 0), (6, [1.0, None], 0), (7, rows[0][1], None), (8, [], 1), (9, [1e-30, 0.0], 1), (10, [5.0, 0.0], 1), (11, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, key string, home int")
    stored = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, **kw).collect()}
    assert got == brute(stored)
    assert all(r.kept == (r.vec_id == r.component_id) for r in near_vectors(df, **kw).collect())


def test_null_and_repeated_ids_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.01], 1)], schema)
    rows = sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()), key=str)
    assert rows == sorted([("4", 2, 3, False), ("4", 2, 3, False), ("None", 0, None, False), ("3", 2, 3, True)], key=str)


@pytest.mark.parametrize("kw", [{}, {"cell_rows": 2, "block_rows": 2}])
def test_repeated_ids_with_other_vectors(spark, kw):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (3, [1.0, 0.01], 1), (4, [0.01, 1.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df, **kw).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False), (4, 1, 1, False)]


@pytest.mark.parametrize("radii", [False, True])
@pytest.mark.parametrize("n", [1, 7, 60])
def test_two_levels_lose_no_neighbour(n, radii):
    """A vector visits the home cell of every vector within r, has one home, and visits it too."""
    rng = np.random.default_rng(n)
    x = np.repeat(rng.normal(size=(25, 6)), 20, axis=0) + rng.normal(scale=0.15, size=(500, 6))
    x = np.vstack([x, x[:5], np.eye(6)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    r = 0.35
    pivots = Pivots.of(x[::3], n, 5)
    if radii:
        pivots = Pivots(pivots.first, pivots.below, *pivots.radii(x))
    home, visits = {}, set()
    for rows, cells, is_home in pivots.cells(x, r):
        for i, c, h in zip(rows.tolist(), cells.tolist(), is_home.tolist(), strict=True):
            visits.add((i, c))
            if h:
                assert i not in home
                home[i] = c
    assert len(home) == len(x) and all((i, c) in visits for i, c in home.items())
    near = np.argwhere(np.linalg.norm(x[:, None] - x[None], axis=2) <= r)
    assert all((i, home[j]) in visits for i, j in near.tolist())
    assert Pivots.of(np.ones((3, 6)) / np.sqrt(6), 9, 2).first.shape == (3, 6)


def test_replication_stays_constant_as_rows_grow():
    """Ten times the rows and ten times the pivots: cells visited by row stay as few, where rows cluster."""
    rng = np.random.default_rng(1)
    visited = []
    for clusters in (60, 600):
        centre = rng.normal(size=(clusters, 32))
        x = np.repeat(centre, 20, axis=0) + rng.normal(scale=0.05, size=(20 * clusters, 32))
        x /= np.linalg.norm(x, axis=1)[:, None]
        pivots = Pivots.of(x[::2], clusters)
        pivots = Pivots(pivots.first, pivots.below, *pivots.radii(x))
        visited.append(sum(len(rows) for rows, _, _ in pivots.cells(x, 0.2)) / len(x))
    assert max(visited) < 2, visited
