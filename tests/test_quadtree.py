"""Grids that adapt, years and stored pieces."""

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reefline.geo import functions as G
from reefline.geo import joins as J
from reefline.geo import kernel as K
from reefline.geo import quadtree as Q
from reefline.geo import stored as P

BOX = "id long, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rows):
    return spark.createDataFrame(rows, BOX).select("id", G.st_box("x0", "y0", "x1", "y1").alias("geometry"))


def crowd(seed, n):
    """Half of the boxes within a hundredth of the width."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        s = 1.0 if k % 2 else 100.0
        x, y, w = rng.random() * s, rng.random() * s, rng.random() * s / 50
        out.append((k, x, y, x + w, y + w))
    return out


def test_leaves_split_where_points_crowd():
    rng = np.random.default_rng(0)
    x, y = np.concatenate([rng.random(1000), rng.random(50) * 100]), np.concatenate([rng.random(1000), rng.random(50) * 100])
    tree = Q.Quadtree.of(x, y, (0.0, 0.0, 100.0, 100.0), 40)
    leaf = tree.child == 0
    points = np.column_stack([x, y, x, y])
    row, at = tree.met(points)
    assert set(row) == set(range(len(x))) and np.bincount(at).max() <= 40
    assert np.isclose((tree.width * tree.height)[leaf].sum(), 10_000)  # leaves tile the world
    assert tree.width[leaf].min() < 1 < 12 < tree.width[leaf].max()
    same = Q.Quadtree.of(np.zeros(500), np.zeros(500), (0.0, 0.0, 1.0, 1.0), 10)
    assert (same.child == 0).sum() <= Q.LEAVES


def test_leaves_are_bounded():
    rng = np.random.default_rng(1)
    tree = Q.Quadtree.of(rng.random(20_000), rng.random(20_000), (0.0, 0.0, 1.0, 1.0), 1, leaves=64)
    assert (tree.child == 0).sum() <= 64
    row, _ = tree.met(np.array([[-5.0, -5.0, 5.0, 5.0]]))
    assert len(row) == (tree.child == 0).sum()


@pytest.mark.parametrize("capacity", [5, 10_000])
def test_join_equals_all_pairs(spark, capacity):
    a, b = [*crowd(1, 120), (500, -10.0, -10.0, 200.0, 200.0), (501, 50.0, 50.0, 50.0, 50.0)], [*crowd(2, 80), (900, 0.0, 0.0, 1.0, 1.0), (901, 1.0, 1.0, 2.0, 2.0)]
    pairs = Q.adaptive_join(boxes(spark, a), boxes(spark, b), "id", "id", "intersects", capacity).select("id", "id_r").collect()
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(pairs) == len(want) and {tuple(r) for r in pairs} == want
    assert {tuple(r) for r in J.spatial_join(boxes(spark, a), boxes(spark, b), "intersects", 8.0).select("id", "id_r").collect()} == want


def test_shapes_travel_with_pairs_only(spark):
    """Before the boxes are tested no shape is shuffled."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        Q.adaptive_join(boxes(spark, crowd(1, 20)), boxes(spark, crowd(2, 20)), "id", "id").explain("formatted")
    assert "CartesianProduct" not in text.getvalue() and "NestedLoop" not in text.getvalue()


def test_nulls_and_empty_tables(spark):
    some = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)])
    odd = spark.createDataFrame([(5, None), (6, K.to_wkb([]))], "id long, geometry binary")
    assert Q.adaptive_join(some, odd, "id", "id").collect() == []
    assert Q.adaptive_join(odd, some.where("false"), "id", "id").collect() == []
    assert Q.first_cover(odd.withColumn("year", F.lit(2000)), [], "year").collect() == []


def test_first_cover(spark):
    rng = random.Random(4)
    rows = [(k, k % 2, 2000 + rng.randrange(6), float(rng.randrange(12)), float(rng.randrange(12)), rng.randrange(1, 6), rng.randrange(1, 6)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, k long, year int, x double, y double, w int, h int").select("k", "year", G.st_box("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("geometry"))
    first: dict = {}
    for _, k, year, x, y, w, h in rows:
        for i in range(w):
            for j in range(h):
                cell = (k, int(x) + i, int(y) + j)
                first[cell] = min(first.get(cell, year), year)
    for capacity in (4, 1000):
        new = Q.first_cover(df, ["k"], capacity=capacity).groupBy("k", "year").agg(F.sum(G.st_area("geometry")).alias("a")).collect()
        assert {(r.k, r.year): round(r.a, 6) for r in new} == {(k, y): float(sum(c[0] == k and f == y for c, f in first.items())) for k in (0, 1) for y in set(first.values()) if any(c[0] == k and f == y for c, f in first.items())}
    years = spark.createDataFrame([(1990,), (2001,), (2003,), (2050,)], "year int")
    got = {(r.k, r.year): round(r.area, 6) for r in Q.covered_by_year(df, ["k"], years).collect()}
    assert got == {(k, y): float(sum(c[0] == k and f <= y for c, f in first.items())) for k in (0, 1) for y in (2001, 2003, 2050)}


def test_split_difference(spark):
    left = boxes(spark, [(1, 0.0, 0.0, 10.0, 10.0), (2, 20.0, 0.0, 22.0, 2.0), (3, 1.0, 1.0, 2.0, 2.0)])
    right = boxes(spark, [(k, float(k), float(k), k + 3.0, k + 3.0) for k in range(0, 9, 2)])
    got = {r.id: r.a for r in Q.split_difference(left, right, "id", capacity=2).groupBy("id").agg(F.sum(G.st_area("geometry")).alias("a")).collect()}
    assert got == pytest.approx({1: 100 - 5 * 9 + 4 + 5, 2: 4.0})  # neighbours share 1, the last one reaches 1 x 3 + 3 x 1 - 1 out
    assert {r.id for r in J.subtract(left, right, "id").collect()} == {1, 2, 3}


def test_stored_pieces_are_pruned(spark, tmp_path):
    rows = [("a", 0.0, 0.0, 25.0, 5.0), ("b", 31.0, 31.0, 33.0, 33.0), ("c", -9.0, -9.0, -1.0, -1.0), (None, 0.0, 0.0, 1.0, 1.0)]
    shapes = spark.createDataFrame(rows, "location string, x0 double, y0 double, x1 double, y1 double").select("location", G.st_box("x0", "y0", "x1", "y1").alias("geometry"))
    path = str(tmp_path / "pieces")
    P.store_pieces(shapes, path)
    assert spark.read.parquet(path).count() == 3 + 1 + 1 + 1
    polygon = K.to_wkb([[np.array([[2.0, 1.0], [12.0, 1.0], [12.0, 4.0], [2.0, 4.0], [2.0, 1.0]])]])
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        P.near(spark, path, polygon).explain("formatted")
    filters = next(x for x in text.getvalue().splitlines() if "PartitionFilters" in x)
    assert "cell_x" in filters and "cell_y" in filters and "PartitionFilters: []" not in filters
    assert {(r.cell_x, r.cell_y) for r in P.near(spark, path, polygon).collect()} == {(0, 0), (1, 0)}
    out = P.analyse_stored(spark, path, polygon, projection="6933").collect()
    assert [r.location for r in out] == ["a"] and out[0].portion_area == pytest.approx(out[0].total_area)
    moll = P.analyse_stored(spark, path, polygon).first()
    assert moll.portion_area == pytest.approx(out[0].portion_area, rel=0.01)
    with pytest.raises(ValueError, match="empty"):
        P.near(spark, path, K.to_wkb([]))


def test_split_difference_of_a_crowd(spark):
    """Equal shapes are cut once and each keeps its rest; 900 shapes under 300 cutters took minutes."""
    x = F.col("id") * 0.01
    rows = spark.range(300)
    cutters = rows.select(G.st_box(x, F.lit(0.0), x + 1, F.lit(1.0)).alias("geometry"))
    shapes = rows.withColumn("c", F.explode(F.array(F.lit(0), F.lit(300), F.lit(600)))).select((F.col("id") + F.col("c")).alias("id"), G.st_box(x, F.lit(0.0), x + 1, F.lit(2.0)).alias("geometry"))
    out = Q.split_difference(shapes, cutters, "id", capacity=20)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    got = {r.id: round(r.a, 6) for r in out.groupBy("id").agg(F.sum(G.st_area("geometry")).alias("a")).collect()}
    assert len(got) == 900 and set(got.values()) == {1.0}


def test_dealt_tables_are_not_gathered(spark):
    """Rows of a small file go to many leaves: the driver broadcasts none of them, and equal shapes meet once."""
    from reefline.plans.catalog import QUERIES

    out = QUERIES["crowded_overlaps"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()


def test_years_are_read_with_their_shapes(spark):
    """No join of a table with itself, which was broadcast; equal shapes count from their earliest year."""
    from reefline.plans.catalog import QUERIES

    out = QUERIES["coverage_by_shape_year"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    rows = [(1, 5, 0.0, 4.0), (1, 3, 0.0, 4.0), (1, 4, 2.0, 6.0), (2, 9, 2.0, 6.0), (1, None, 0.0, 99.0)]
    df = spark.createDataFrame(rows, "k int, year int, x0 double, x1 double").select("k", "year", G.st_box("x0", F.lit(0.0), "x1", F.lit(1.0)).alias("geometry"))
    got = Q.first_cover(df, ["k"], capacity=1).groupBy("k", "year").agg(F.sum(G.st_area("geometry")).alias("a")).collect()
    assert {(r.k, r.year): round(r.a, 9) for r in got} == {(1, 3): 4.0, (1, 4): 2.0, (2, 9): 4.0}
