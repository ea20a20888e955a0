"""Dissolving by edges that cancel, against unions made at once."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reefline.geo import dissolve as D
from reefline.geo import functions as G
from reefline.geo import kernel as K
from reefline.operators.components import components


def star(rng, n=9):
    """A polygon whose vertices go once around a point."""
    x, y = rng.random() * 10, rng.random() * 10
    at = sorted(rng.random() * 2 * math.pi for _ in range(n))
    r = [0.5 + rng.random() * 1.5 for _ in range(n)]
    ring = [(x + q * math.cos(a), y + q * math.sin(a)) for a, q in zip(at, r, strict=True)]
    return K.to_wkb([[np.array([*ring, ring[0]])]])


def parts_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "k string, geometry binary")
    return [(r.k, K.from_wkb(r.geometry)) for r in D.dissolve_parts(df, ["k"], **options).collect()]


@pytest.mark.parametrize("capacity", [4, 1000])
def test_areas_and_rings_of_stars(spark, capacity):
    rng = random.Random(capacity)
    rows = [(k, star(rng)) for k in "ab" for _ in range(25)]
    parts = parts_of(spark, [*rows, rows[0], rows[0]], capacity=capacity)
    for key in "ab":
        whole = K.union([K.from_wkb(w) for k, w in rows if k == key])
        own = [g for k, g in parts if k == key]
        assert sum(K.area(g) for g in own) == pytest.approx(K.area(whole), rel=1e-8)
        assert sum(K.area(K.intersection(g, whole)) for g in own) == pytest.approx(K.area(whole), rel=1e-8)
        for i, a in enumerate(own):  # parts are apart, and a part's outer ring comes first
            assert all(K.intersection_area(a, b) < 1e-9 for b in own[i + 1 :])
            areas = [abs(K.ring_area(r)) for r in a[0]]
            assert areas[0] == max(areas)
            assert K.area([a[0]]) == pytest.approx(areas[0] - sum(areas[1:]), rel=1e-8)


def test_holes_and_neighbours(spark):
    box = lambda *b: K.to_wkb(K.box(*b))
    frame = [("f", box(0, 0, 5, 1)), ("f", box(0, 4, 5, 5)), ("f", box(0, 0, 1, 5)), ("f", box(4, 0, 5, 5)), ("f", box(2, 2, 3, 3))]
    tiles = [("t", box(i, j, i + 1, j + 1)) for i in range(8) for j in range(8)]
    touch = [("p", box(0, 0, 1, 1)), ("p", box(1, 1, 2, 2))]
    parts = parts_of(spark, [*frame, *tiles, *touch, ("z", None), ("z", K.to_wkb([])), (None, box(0, 0, 1, 1))], capacity=3)
    f = sorted((g for k, g in parts if k == "f"), key=K.area)
    assert [K.area(g) for g in f] == pytest.approx([1, 16]) and [len(g[0]) for g in f] == [1, 2]
    assert [len(r) for r in f[1][0]] == [5, 5]  # no vertices along straight lines
    t = [g for k, g in parts if k == "t"]
    assert len(t) == 1 and K.area(t[0]) == pytest.approx(64) and len(t[0][0]) == 1 and len(t[0][0][0]) == 5
    assert sum(k == "p" for k, _ in parts) == 2 and {k for k, _ in parts} == {"f", "t", "p"}


def test_no_task_sees_inner_edges(spark):
    """What is chained is the boundary: of a full grid its four sides, cut at bands and leaves."""
    tiles = spark.range(900).select(F.lit("t").alias("k"), G.st_box((F.col("id") % 30).cast("double"), F.floor(F.col("id") / 30).cast("double"), (F.col("id") % 30 + 1).cast("double"), (F.floor(F.col("id") / 30) + 1).cast("double")).alias("geometry"))
    assert [round(r.a, 6) for r in D.dissolve_parts(tiles, ["k"], capacity=20).select(G.st_area("geometry").alias("a")).collect()] == [900.0]
    empty = D.dissolve_parts(tiles.where("false"), ["k"])
    assert empty.columns == ["k", "geometry"] and empty.collect() == []


def test_chaining_keeps_rings_apart():
    square = lambda x, y: [(x, y, x + 1, y), (x + 1, y, x + 1, y + 1), (x + 1, y + 1, x, y + 1), (x, y + 1, x, y)]
    rings = D.chained(np.array([*square(0, 0), *square(1, 1)]))
    assert sorted(len(r) for r in rings) == [5, 5]
    assert [len(r) for r in D.chained(np.array([(0, 0, 1, 0), (1, 0, 2, 0), (2, 0, 0, 2), (0, 2, 0, 1), (0, 1, 0, 0)]))] == [4]


def test_components(spark):
    rng = random.Random(8)
    pairs = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(7, 7)]
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    alone = {n for n in parent if all(n not in p or p[0] == p[1] for p in pairs)}
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent if n not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
