"""The algebra of runs against sets of pixels."""

import random

import pytest
from pyspark.sql import functions as F

from reefline.geo.functions import st_box
from reefline.raster import spans as S
from reefline.raster import zonal as Z

T = Z.Transform(0.1, -0.1, 0.0, 5.0)
RUNS = "location string, row long, col0 long, col1 long"


def drawn(seed, n=60, rows=4, cols=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(cols)
        out.append((rng.choice("ab"), rng.randrange(rows), a, a + rng.randrange(9)))
    return out


def pixels(runs, keyed=True):
    return {((k,) if keyed else ()) + (r, c) for k, r, a, b in runs for c in range(a, b + 1)}


def back(df, keys):
    got = [tuple(r[k] for k in keys) + (r.row, c) for r in df.collect() for c in range(r.col0, r.col1 + 1)]
    assert len(got) == len(set(got))  # runs are disjoint
    return set(got)


@pytest.mark.parametrize("width", [256, 7])
def test_algebra(spark, width):
    a, b = drawn(1), drawn(2, 40)
    da, db = spark.createDataFrame(a, RUNS), spark.createDataFrame(b, RUNS)
    assert back(S.union(da, ["location"], width), ["location"]) == pixels(a)
    assert back(S.intersection(da, db, ["location"], width), ["location"]) == pixels(a) & pixels(b)
    assert back(S.difference(da, db, ["location"], width), ["location"]) == pixels(a) - pixels(b)
    assert back(S.union(da, (), width), []) == pixels(a, False)
    three = S.combined({"a": da, "b": db, "c": da.where("col0 % 2 = 0")}, "n_a > 0 and n_b = 0 or n_c > 1", (), width)
    count = lambda runs, p: sum(r == p[0] and x <= p[1] <= y for _, r, x, y in runs)
    even = [r for r in a if r[2] % 2 == 0]
    assert back(three, []) == {p for p in pixels(a, False) | pixels(b, False) if count(a, p) and not count(b, p) or count(even, p) > 1}


def test_runs_touch_within_tiles_only(spark):
    df = spark.createDataFrame([("a", 0, 0, 3), ("a", 0, 4, 9), ("a", 0, 12, 12), ("a", 1, 5, 4)], RUNS)
    assert sorted((r.row, r.col0, r.col1) for r in S.union(df, ["location"], 8).collect()) == [(0, 0, 7), (0, 8, 9), (0, 12, 12)]
    assert S.union(df.where("false"), ["location"]).collect() == []


def test_crowded_places_stay_small(spark):
    """However many runs lie over a place, what a window sees of a tile's row are its borders."""
    df = spark.range(20_000).select(F.lit("a").alias("location"), F.lit(0).cast("long").alias("row"), (F.col("id") % 5).alias("col0"), (F.col("id") % 5 + F.col("id") % 7).alias("col1"))
    swept = S.swept({"a": df}, ["location"])
    assert swept.count() <= 11 and swept.agg(F.max("n_a")).first()[0] > 10_000


def test_value_runs(spark):
    rows = [(0, c, v) for c, v in enumerate([1, 1, 2, 2, 2, None, 1, float("nan"), 9, 9, 1])] + [(0, 3, 2.0), (1, 0, 1.0)]
    got = S.value_runs(spark.createDataFrame([(r, c, None if v is None else float(v)) for r, c, v in rows], "row long, col long, value double"), nodata=9)
    assert sorted((r.row, r.col0, r.col1, r.value) for r in got.collect()) == [(0, 0, 1, 1), (0, 2, 2, 2), (0, 3, 3, 2), (0, 3, 3, 2), (0, 4, 4, 2), (0, 6, 6, 1), (0, 10, 10, 1), (1, 0, 0, 1)]


@pytest.fixture
def raster(spark):
    return spark.range(50 * 80).select(F.floor(F.col("id") / 80).alias("row"), (F.col("id") % 80).alias("col"), (F.col("id") % 3).cast("int").alias("value"))


def masks(spark, boxes):
    df = spark.createDataFrame(boxes, "location string, x0 double, y0 double, x1 double, y1 double").select("location", st_box("x0", "y0", "x1", "y1").alias("geometry"))
    return Z.spans(df, T, 50, 80)


def test_half_the_area_protected(spark, raster):
    zones = masks(spark, [("a", 1.0, 1.0, 3.0, 3.0), ("b", 100.0, 0.0, 101.0, 1.0), ("c", 5.0, 1.0, 6.0, 2.0)])
    areas = masks(spark, [("a", 1.0, 1.0, 2.0, 3.0), ("a", 1.5, 2.0, 2.0, 9.0), ("b", 1.0, 1.0, 2.0, 2.0), ("x", 5.0, 1.0, 6.0, 2.0)])
    names = {0: "zero", 1: "one"}
    total = {(r.location, r["class"]): r.area_km2 for r in S.class_areas_under(raster, zones, T, names, include_zero=True).collect()}
    held = {(r.location, r["class"]): r.area_km2 for r in S.class_areas_under(raster, zones, T, names, areas, include_zero=True).collect()}
    assert {k for k, _ in total} == {"a", "c"} and {k for k, _ in held} == {"a"}  # outside the raster, without areas of its own
    assert {c for _, c in total} == {"zero", "one", "class_2"}
    assert sum(v for (k, _), v in held.items()) == pytest.approx(sum(v for (k, _), v in total.items() if k == "a") / 2, rel=1e-9)
    assert {c for _, c in {(r.location, r["class"]) for r in S.class_areas_under(raster, zones, T, names).collect()}} == {"one", "class_2"}


def test_claims_equal_passes_of_their_own(spark, raster):
    zones = masks(spark, [("a", 1.0, 1.0, 3.0, 3.0), ("a", 2.0, 2.0, 3.5, 3.5), ("b", 2.0, 0.5, 4.0, 2.5), ("c", 2.2, 2.2, 2.8, 2.4)])
    areas = masks(spark, [("x", 0.0, 0.0, 2.5, 9.0), ("y", 2.0, 2.0, 2.7, 2.6)])
    names = {0: "zero", 1: "one", 2: "two"}
    got = {(r.location, r["class"]): (r.total_area, r.protected_area) for r in S.claimed_class_areas(raster, zones, areas, T, names, width=16).collect()}
    world = zones.withColumn("location", F.lit("GLOB"))
    for z in (zones, world):
        total = {(r.location, r["class"]): r.area_km2 for r in S.class_areas_under(raster, z, T, names, include_zero=True).collect()}
        every = z.select("location").distinct().crossJoin(areas.drop("location"))
        held = {(r.location, r["class"]): r.area_km2 for r in S.class_areas_under(raster, z, T, names, every, include_zero=True).collect()}
        for k, v in total.items():
            assert got[k] == pytest.approx((v, held.get(k, 0.0)))
    assert {k for k, _ in got} == {"a", "b", "c", "GLOB"}
    each = sum(t for (k, _), (t, _) in got.items() if k != "GLOB")
    assert each > sum(t for (k, _), (t, _) in got.items() if k == "GLOB")  # claims overlap
