"""Simplification by arcs: neighbours keep common borders."""

import math
import random

import numpy as np
import pytest

from reefline.geo import kernel as K
from reefline.geo.topology import chain, simplify_shared, thinned


def jagged(a, b, seed, steps=12, width=0.03):
    """A line of points from a to b that wavers, the same whoever asks for it."""
    (a, b), back = (sorted((a, b)), a > b)
    rng = random.Random(f"{a}{b}{seed}")
    n = (-(b[1] - a[1]), b[0] - a[0])
    line = [a] + [(a[0] + (b[0] - a[0]) * t + n[0] * o, a[1] + (b[1] - a[1]) * t + n[1] * o) for t, o in ((k / steps, (rng.random() - 0.5) * width) for k in range(1, steps))] + [b]
    return line[::-1] if back else line


def tiling(n, seed):
    """n x n cells whose inner borders waver; the outer ones are straight."""
    cells = []
    for i in range(n):
        for j in range(n):
            corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1), (i, j)]
            ring = []
            for a, b in zip(corners, corners[1:], strict=False):
                outer = (a[0] == b[0] and a[0] in (0, n)) or (a[1] == b[1] and a[1] in (0, n))
                ring += jagged(a, b, seed, width=0.0 if outer else 0.03)[:-1]
            cells.append(np.array([*ring, ring[0]], dtype=float))
    return cells


def run(spark, geometries, tolerance):
    df = spark.createDataFrame([(k, None if g is None else K.to_wkb(g)) for k, g in enumerate(geometries)], "id long, geometry binary")
    return {r.id: K.from_wkb(r.geometry) for r in simplify_shared(df, tolerance).collect()}


def sides(g):
    return {tuple(sorted((tuple(a), tuple(b)))) for p in g for r in p for a, b in zip(r[:-1].tolist(), r[1:].tolist(), strict=True)}


def test_neighbours_share_borders(spark):
    cells = tiling(4, 1)
    got = run(spark, [[[c]] for c in cells], 0.05)
    assert sum(K.area(g) for g in got.values()) == pytest.approx(16, abs=1e-9)
    assert K.area([p for g in got.values() for p in g]) == pytest.approx(16, abs=1e-9)  # no gaps, no overlaps
    owners: dict = {}
    for k, g in got.items():
        for s in sides(g):
            owners.setdefault(s, set()).add(k)
    outer = [s for s, o in owners.items() if len(o) == 1]
    assert all(len(o) <= 2 for o in owners.values())
    assert sum(math.dist(*s) for s in outer) == pytest.approx(16)  # every other side has two owners
    assert all(len(g[0][0]) == 5 for g in got.values())  # what wavers is gone, corners stay


def test_zero_tolerance_changes_no_area(spark):
    cells = tiling(3, 2)
    got = run(spark, [[[c]] for c in cells], 0.0)
    assert [K.area(got[k]) for k in range(9)] == pytest.approx([K.area([[c]]) for c in cells])


def test_rings_without_nodes_and_holes(spark):
    circle = lambda x, y, r, n=60: np.array([(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)] + [(x + r, y)])
    disc, ring = circle(5, 5, 1.0), circle(5, 5, 3.0)
    got = run(spark, [[[ring, disc]], [[disc]], [[circle(20, 20, 0.001)]], None, []], 0.1)
    assert len(got[0][0]) == 2 and sides([[got[0][0][1]]]) == sides(got[1])  # the hole and what fills it
    assert 8 < len(got[0][0][0]) < 60 and K.area(got[0]) == pytest.approx(math.pi * 8, rel=0.05)
    assert K.area(got[2]) > 0 and got[3] is None and got[4] == []


def test_two_arcs_between_the_same_ends(spark):
    """A thin lens between two halves doesn't close."""
    left, right = [(0, 0), (-0.01, 0.5), (0, 1)], [(0, 0), (0.01, 0.5), (0, 1)]
    ring = lambda *p: np.array([*p, p[0]], dtype=float)
    got = run(spark, [[[ring(*left, *right[::-1][1:-1])]], [[ring((-1, 0), *left, (-1, 1))]], [[ring((1, 0), *right, (1, 1))]]], 0.1)
    assert [round(K.area(got[k]), 9) for k in range(3)] == [0.01, 0.995, 0.995]


def test_repeated_shapes_and_empty_table(spark):
    cell = tiling(1, 3)[0]
    got = run(spark, [[[cell]]] * 3, 0.05)
    assert len({K.to_wkb(g) for g in got.values()}) == 1 and len(got) == 3
    assert run(spark, [], 0.05) == {}


def test_lines():
    edges = np.array([(0, 0, 1, 0), (1, 0, 2, 1), (2, 1, 3, 1)], dtype=float)
    assert chain(edges[[1, 2, 0]]).tolist() == [[0, 0], [1, 0], [2, 1], [3, 1]]
    loop = chain(np.array([(0, 0, 1, 0), (1, 0, 1, 1), (0, 0, 1, 1)], dtype=float))
    assert loop.tolist()[0] == loop.tolist()[-1] == [0, 0] and len(loop) == 4
    wave = np.array([(k, 0.01 * (k % 2)) for k in range(9)], dtype=float)
    assert len(thinned(wave, 0.1, False)) == 2 and len(thinned(wave, 0.1, True)) == 3 and len(thinned(wave, 0.001, False)) == 9
