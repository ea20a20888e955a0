"""Crowded tables: what covers a shape is united by cell, equal shapes are measured once. Through pairs each
of these took minutes, or more memory than a task has."""

import time

import pytest
from pyspark.sql import functions as F

from reefline.geo import functions as G
from reefline.geo import joins as J

N = 300


@pytest.fixture(scope="module")
def crowd(spark):
    """Sites that cover 0 to 3.99 by 0 to 1 and overlap a hundredfold, shapes of 1 by 2 of which each has half
    covered, both in steps of a hundredth; scaled."""

    def made(scale=1.0):
        x = F.col("id") * 0.01
        box = lambda h: G.st_box(x * scale, F.lit(0.0), (x + 1) * scale, F.lit(h * scale)).alias("geometry")
        rows = spark.range(N)
        return rows.select("id", box(1.0)), rows.select("id", box(2.0))

    return made


@pytest.fixture(autouse=True)
def in_time():
    began = time.perf_counter()
    yield
    assert time.perf_counter() - began < 90


def test_sea_level(crowd):
    sites, seas = crowd(1000.0)
    seas = seas.select(F.col("id").alias("MRGID"), F.lit(2.0).alias("total_area"), "geometry")
    got = J.sea_level(seas.unionByName(seas.where("MRGID = 7")), sites, "highly", size=400.0).collect()
    assert len(got) == N and {(round(r.area, 6), round(r.pct, 6)) for r in got} == {(1.0, 50.0)}


def test_several_shapes_of_a_key(spark):
    """Overlapping shapes of one key count once."""
    rows = spark.createDataFrame([("a", 0.0, 3.0), ("a", 2.0, 5.0), ("b", 2.0, 5.0), ("c", 8.0, 9.0), (None, 4.0, 7.0)], "k string, x0 double, x1 double")
    left = rows.select("k", G.st_box("x0", F.lit(0.0), "x1", F.lit(2.0)).alias("geometry"))
    cells = J.united_cells(spark.range(1).select(G.st_box(F.lit(1.0), F.lit(1.0), F.lit(6.0), F.lit(7.0)).alias("geometry")), 2.0)
    assert {r.k: round(r.area, 9) for r in J.covered(left, cells, ["k"], 2.0).collect()} == {"a": 4.0, "b": 3.0, None: 2.0}


def test_mangroves(crowd):
    from reefline.operators import zones as Z

    woods, zones = crowd(1.0)
    got = Z.mangroves_by_location(woods, zones.withColumn("location", F.col("id").cast("string")), woods.where("id < 100"), 0.5).collect()
    full = max(r.total_mangrove_area_km2 for r in got)
    assert len(got) == N and {round(r.total_mangrove_area_km2 / full, 6) for r in got} == {1.0}
    held = {int(r.location): r.protected_mangrove_area_km2 / full for r in got}
    assert all(v == pytest.approx(min(1.0, max(0.0, 1.99 - k * 0.01)), abs=1e-6) for k, v in held.items())


def test_sea_coverage(crowd):
    sites, seas = crowd(1000.0)
    areas = sites.select((F.col("id") % 2).alias("PA_DEF"), "geometry")
    got = {int(r.location): r for r in J.sea_coverage(seas.select(F.col("id").alias("MRGID"), "geometry"), areas.unionByName(areas), projected=True, size=400.0).collect()}
    assert len(got) == N and {(r.protected_area, r.coverage) for r in got.values()} == {(1.0, 50.0)}
    assert all(got[k].protected_areas_count == 2 * sum(abs(i - k) < 100 for i in range(N)) for k in (0, 150, 299))
    assert (got[150].pas, got[0].pas, got[0].oecms) == (100.0, 99.0, 1.0)


def test_equal_shapes_are_measured_once(crowd):
    sites, shapes = crowd(1.0)
    many = sites.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("id", F.col("id") + N * F.col("c")).drop("c")
    pairs = J.spatial_join(J.different(many, "id"), J.different(shapes, "id"), "intersects", 0.5)
    want = sum(abs(a - b) <= 100 for a in range(N) for b in range(N))
    assert want - 2 * N <= pairs.count() <= want  # shapes that only touch may miss by rounding
    got = {r.id: (r.n, round(r.shared, 6)) for r in J.shared_by_right(pairs, shapes.unionByName(shapes.where("id = 3").withColumn("id", F.lit(-3).cast("long")))).collect()}
    assert got[-3] == got[3] and len(got) == N + 1
    assert got[150][1] == pytest.approx(40 * (1 + 2 * sum(1 - d / 100 for d in range(1, 100))), abs=1e-4)


def test_subtracted(crowd):
    cutters, shapes = crowd(1.0)
    out = J.subtract(shapes.unionByName(shapes.where("id = 5")), cutters, "id", 0.5)
    got = out.select("id", G.st_area("geometry").alias("a")).collect()
    assert len(got) == N + 1 and {round(r.a, 6) for r in got} == {1.0}


def test_what_is_given_back_is_not_gathered(spark):
    """A table that looks small by its file isn't broadcast, however many rows have a shape."""
    from reefline.plans.catalog import QUERIES

    out = QUERIES["overlaid"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    rows = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 1.0)], "id int, x double").select("id", G.st_box("x", F.lit(0.0), F.col("x") + 1, F.lit(1.0)).alias("geometry"))
    found = J.different(rows).select(F.col("geometry").alias("_shape"), "n")
    assert sorted((r.id, r.n) for r in J.given_back(rows, found).collect()) == [(1, 2), (2, 2), (3, 1)]
