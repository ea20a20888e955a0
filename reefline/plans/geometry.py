"""Geometry and raster queries, with closed forms as their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.geo import functions as G
from reefline.geo import joins as J
from reefline.plans.catalog import query, r6, table
from reefline.raster import zonal as Z

#: Boxes from numbers of the tables: parts by key and size, suppliers by key.
_PARTS = "SELECT p_partkey AS id, (p_partkey % 97)::DOUBLE AS x0, (p_partkey % 89)::DOUBLE AS y0, (p_partkey % 97 + 1 + p_size % 5)::DOUBLE AS x1, (p_partkey % 89 + 2)::DOUBLE AS y1 FROM part"
_SUPPLIERS = "SELECT s_suppkey AS id, (s_suppkey % 83) + 0.5::DOUBLE AS x0, (s_suppkey % 79) + 0.5::DOUBLE AS y0, (s_suppkey % 83) + 3.5::DOUBLE AS x1, (s_suppkey % 79) + 2.5::DOUBLE AS y1 FROM supplier"


def _parts(spark: SparkSession, sf_dir: str, *others: Column) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k % 97).cast("double"), (k % 89).cast("double")
    return table(spark, sf_dir, "part").select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 1 + F.col("p_size") % 5).alias("x1"), (y + 2).alias("y1"), *others)


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k % 83) + 0.5, (k % 79) + 0.5
    return table(spark, sf_dir, "supplier").select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 3).alias("x1"), (y + 2).alias("y1"))


def _boxes(df: DataFrame) -> DataFrame:
    return df.select("id", G.st_box("x0", "y0", "x1", "y1").alias("geometry"))


_OVERLAP = f"""FROM ({_PARTS}) a JOIN ({_SUPPLIERS}) b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"""
_SHARED = "(LEAST(a.x1, b.x1) - GREATEST(a.x0, b.x0)) * (LEAST(a.y1, b.y1) - GREATEST(a.y0, b.y0))"


@query(f"SELECT a.id AS id_a, b.id AS id_b, {_SHARED} AS shared {_OVERLAP}")
def rectangle_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rectangles by a join on grid cells, in plain columns."""
    return J.rectangle_pairs(_parts(spark, sf_dir), _suppliers(spark, sf_dir), 8.0)


@query(f"SELECT b.id AS id_r, COUNT(*) AS n, ROUND(SUM({_SHARED}), 6) AS shared {_OVERLAP} GROUP BY b.id")
def spatial_join_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through WKB, the cell join and the geometry kernel."""
    left, right = _boxes(_parts(spark, sf_dir)), _boxes(_suppliers(spark, sf_dir))
    pairs = J.spatial_join(J.different(left, "id"), J.different(right, "id"), "intersects", 8.0)
    return J.shared_by_right(pairs, right).select(F.col("id").alias("id_r"), "n", r6("shared").alias("shared"))


@query(f"SELECT a.id AS id, b.id AS id_r FROM ({_PARTS}) a JOIN ({_SUPPLIERS}) b ON a.x0 + 1 BETWEEN b.x0 AND b.x1 AND a.y0 + 1 BETWEEN b.y0 AND b.y1")
def points_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _parts(spark, sf_dir).select("id", G.st_point(F.col("x0") + 1, F.col("y0") + 1).alias("geometry"))
    return J.spatial_join(points, _boxes(_suppliers(spark, sf_dir)), "within", 8.0).select("id", "id_r")


@query(f"""
WITH p AS ({_PARTS}), c AS (SELECT DISTINCT id % 10 AS k, x, y FROM p, range(0, 110) i(x), range(0, 100) j(y) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1)
SELECT k, CAST(COUNT(*) AS DOUBLE) AS area FROM c GROUP BY k
""")
def union_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the union of each group's boxes, counted once: two levels, by cell and then summed."""
    boxes = _boxes(_parts(spark, sf_dir)).withColumn("k", F.col("id") % 10)
    return J.union_area(boxes, ["k"], "geometry", 20.0).select("k", F.round("area", 6).alias("area"))


@query(f"SELECT id, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x0 AS minx, y1 AS maxy, true AS valid, 'Polygon' AS kind FROM ({_PARTS})")
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(_parts(spark, sf_dir)).select("id", "geometry", G.st_bounds("geometry").alias("b"), G.st_centroid("geometry").alias("c"))
    return b.select("id", r6(G.st_area("geometry")).alias("area"), r6("c.x").alias("cx"), r6("c.y").alias("cy"), F.col("b.minx").alias("minx"), F.col("b.maxy").alias("maxy"), G.st_is_valid("geometry").alias("valid"), G.st_geometry_type("geometry").alias("kind"))


@query(f"SELECT id, ROUND((x1 - x0) * (y1 - y0) - (0.5 + id % 3) * (y1 - y0) * (1 - 0.5 * (id % 2)), 6)::DOUBLE AS left_over FROM ({_SUPPLIERS})")
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of each box taken away whose size depends on the row."""
    s = _suppliers(spark, sf_dir)
    x, y = F.col("x0") + 0.5 + F.col("id") % 3, F.col("y1") - (F.col("id") % 2) * 1.0
    cut = G.st_box(F.col("x0") - 1, F.col("y0") - 1, x, F.when(F.col("id") % 2 == 0, F.col("y1") + 1).otherwise(y))
    return s.select("id", r6(G.st_area(G.st_difference(G.st_box("x0", "y0", "x1", "y1"), cut))).alias("left_over"))


@query(f"SELECT id, CAST(ROUND((x1 - x0) * (y1 - y0)) AS BIGINT) AS n, (x1 - x0) * (y1 - y0) AS area FROM ({_PARTS})")
def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes cut into unit squares."""
    t = _boxes(_parts(spark, sf_dir)).select("id", F.explode(G.st_tiles("geometry", 1.0)).alias("t"))
    return t.groupBy("id").agg(F.count("*").alias("n"), r6(F.sum(G.st_area("t.part"))).alias("area"))


_E2 = "(1 / 298.257223563) * (2 - 1 / 298.257223563)"
_ZONE = "(6378137.0 * 6378137.0 * (1 - {e2}) / 2 / 1e6) * (SIN({l}) / (1 - {e2} * SIN({l}) * SIN({l})) + ATANH(SQRT({e2}) * SIN({l})) / SQRT({e2}))"


def _zone(lat: str) -> str:
    return _ZONE.format(e2=_E2, l=f"RADIANS({lat})")


@query(f"SELECT n_nationkey, ROUND(ABS({_zone('90 - n_nationkey')} - {_zone('89 - n_nationkey')}) * RADIANS(1), 4) AS km2 FROM nation")
def pixel_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of one-degree pixels on the ellipsoid."""
    t = Z.Transform(1.0, -1.0, -180.0, 90.0)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(Z.pixel_area(F.col("n_nationkey"), t), 4).alias("km2"))


@query("""
SELECT v AS code, CAST(CASE WHEN v < 200 THEN 1 WHEN v < 300 THEN 2 WHEN v < 400 THEN 3 WHEN v < 500 THEN 4 WHEN v < 600 OR v IN (910, 984) THEN 5 WHEN v < 800 THEN 6 WHEN v < 900 THEN 7 WHEN v BETWEEN 1400 AND 1499 THEN 8 ELSE 255 END AS INTEGER) AS class
FROM (SELECT DISTINCT p_size * 30 + p_partkey % 15 AS v FROM part)
""")
def land_cover_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_size") * 30 + F.col("p_partkey") % 15).alias("code")).distinct()
    return p.select("code", Z.land_cover_class(F.col("code")).cast("int").alias("class"))


@query("""
SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 6 = 0 THEN 0 WHEN n_nationkey <= 10 THEN round_even(n_nationkey::DOUBLE / 10 * 255, 0) WHEN n_nationkey < 20 THEN round_even(255 - (n_nationkey - 10)::DOUBLE / 10 * 255, 0) ELSE 0 END AS INTEGER) AS r,
 CAST(CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE 255 END AS INTEGER) AS a FROM nation
""")
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours between stops; nodata is transparent."""
    k = F.col("n_nationkey").cast("double")
    v = F.when(F.col("n_nationkey") % 6 == 0, -9.0).otherwise(k)
    stops = {0.0: (0, 0, 0), 10.0: (255, 0, 0), 20.0: (0, 0, 0)}
    n = table(spark, sf_dir, "nation").select("n_nationkey", Z.ramp(v, stops, nodata=-9.0).alias("c"))
    return n.select("n_nationkey", "c.r", "c.a")


@query("""
SELECT c_custkey, CAST(LEAST(255, GREATEST(0, FLOOR((lon + 180) / 360 * 256))) AS BIGINT) AS x, CAST(LEAST(255, GREATEST(0, FLOOR((1 - ASINH(TAN(RADIANS(lat))) / PI()) / 2 * 256))) AS BIGINT) AS y
FROM (SELECT c_custkey, c_custkey % 360 - 179.75 AS lon, c_custkey % 160 - 79.75 AS lat FROM customer)
""")
def tile_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = Z.tile_of(k % 360 - 179.75, k % 160 - 79.75, 8)
    return table(spark, sf_dir, "customer").select("c_custkey", x.alias("x"), y.alias("y"))


@query("SELECT n_nationkey, ROUND(5.0 * (n_nationkey + 1), 2)::DOUBLE AS km2 FROM nation")
def point_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as circles of areas of their own: the equal-area measure gives each back."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", G.st_point((k * 3).cast("double"), (k * 2 - 20).cast("double")).alias("p"))
    return n.select("n_nationkey", F.round(G.st_area_km2(G.st_buffer_km2("p", 5.0 * (k + 1))), 2).alias("km2"))
