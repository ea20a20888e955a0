"""Spatial queries on grids that adapt, stored pieces and years; SQL counts unit squares or boxes in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.geo import dissolve as D
from reefline.geo import functions as G
from reefline.geo import joins as J
from reefline.geo import kernel as K
from reefline.geo import quadtree as Q
from reefline.geo import stored as P
from reefline.geo import topology as T
from reefline.plans.catalog import query, r6, table
from reefline.plans.geometry import _PARTS, _SUPPLIERS, _boxes, _parts, _suppliers, _zone
from reefline.sources import scratch

#: Parts crowd in one square degree (every second one), and supplier 1 covers the world.
_CROWDED = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 40 + p_partkey % 1000 / 1000.0 ELSE p_partkey % 97 END::DOUBLE AS x0,
 CASE WHEN p_partkey % 2 = 0 THEN 40 + p_partkey % 999 / 999.0 ELSE p_partkey % 89 END::DOUBLE AS y0, CASE WHEN p_partkey % 2 = 0 THEN 0.01 ELSE 2 END::DOUBLE AS w FROM part"""
_WITH_WORLD = f"SELECT id, CASE WHEN id = 1 THEN -180 ELSE x0 END::DOUBLE AS x0, CASE WHEN id = 1 THEN -90 ELSE y0 END::DOUBLE AS y0, CASE WHEN id = 1 THEN 180 ELSE x1 END::DOUBLE AS x1, CASE WHEN id = 1 THEN 90 ELSE y1 END::DOUBLE AS y1 FROM ({_SUPPLIERS})"


def _crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    even = k % 2 == 0
    x0 = F.when(even, 40 + k % 1000 / F.lit(1000.0)).otherwise((k % 97).cast("double"))
    y0 = F.when(even, 40 + k % 999 / F.lit(999.0)).otherwise((k % 89).cast("double"))
    w = F.when(even, 0.01).otherwise(2.0)
    return table(spark, sf_dir, "part").select(k.alias("id"), G.st_box(x0, y0, x0 + w, y0 + w).alias("geometry"))


def _with_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = F.col("id") == 1
    corners = [F.when(world, v).otherwise(F.col(c)) for c, v in (("x0", -180.0), ("y0", -90.0), ("x1", 180.0), ("y1", 90.0))]
    return _suppliers(spark, sf_dir).select("id", G.st_box(*corners).alias("geometry"))


@query(f"""
SELECT b.id AS id_r, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM((LEAST(a.x0 + w, b.x1) - GREATEST(a.x0, b.x0)) * (LEAST(a.y0 + w, b.y1) - GREATEST(a.y0, b.y0))), 6) AS shared
FROM ({_CROWDED}) a JOIN ({_WITH_WORLD}) b ON a.x0 < b.x1 AND b.x0 < a.x0 + w AND a.y0 < b.y1 AND b.y0 < a.y0 + w GROUP BY b.id
""")
def crowded_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of boxes half of which crowd in one square degree with boxes one of which is the world: leaves
    of a quadtree in place of cells."""
    right = _with_world(spark, sf_dir)
    pairs = Q.adaptive_join(J.different(_crowded(spark, sf_dir), "id"), J.different(right, "id"), "id", "id", "intersects", capacity=500)
    return J.shared_by_right(pairs, right).select(F.col("id").alias("id_r"), "n", r6("shared").alias("shared"))


@query(f"""
WITH s AS (SELECT id % 5 AS k, x, y, MIN(p_size) AS f FROM ({_PARTS}) JOIN part ON p_partkey = id, range(0, 110) i(x), range(0, 100) j(y) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2, 3),
n AS (SELECT k, f, COUNT(*) AS c FROM s GROUP BY 1, 2), y AS (SELECT DISTINCT p_size AS year FROM part)
SELECT k, year, CAST(SUM(c) AS DOUBLE) AS area FROM y JOIN n ON f <= year GROUP BY 1, 2
""")
def coverage_by_shape_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the union of each group's boxes up to each year: ground counts from its first covering year."""
    years = table(spark, sf_dir, "part").select(F.col("p_size").alias("year"))
    shapes = _parts(spark, sf_dir, F.col("p_size").alias("year")).select((F.col("id") % 5).alias("k"), "year", G.st_box("x0", "y0", "x1", "y1").alias("geometry"))
    return Q.covered_by_year(shapes, ["k"], years, capacity=200).select("k", "year", r6("area").alias("area"))


@query(f"""
WITH p AS ({_PARTS}), s AS ({_SUPPLIERS}), h AS (SELECT id, x / 2.0 AS x, y / 2.0 AS y FROM p, range(0, 220) i(x), range(0, 200) j(y) WHERE x / 2.0 >= x0 AND x / 2.0 < x1 AND y / 2.0 >= y0 AND y / 2.0 < y1)
SELECT id, CAST(COUNT(*) AS DOUBLE) / 4 AS left_over FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE h.x >= s.x0 AND h.x < s.x1 AND h.y >= s.y0 AND h.y < s.y1) GROUP BY id
""")
def subtracted_by_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each box no other table's box covers; cutters meet a shape by leaf, never all of them."""
    rest = Q.split_difference(_boxes(_parts(spark, sf_dir)), _boxes(_suppliers(spark, sf_dir)), "id", capacity=100)
    return rest.groupBy("id").agg(r6(F.sum(G.st_area("geometry"))).alias("left_over")).where("left_over > 0")


@query(f"""
WITH p AS ({_PARTS}), k AS (SELECT 'all' AS k, p.* FROM p UNION ALL SELECT CAST(id % 4 AS VARCHAR), p.* FROM p),
s AS (SELECT DISTINCT k, x, y FROM k, range(0, 110) i(x), range(0, 100) j(y) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1),
n AS (SELECT k, COUNT(*) AS c FROM s JOIN (SELECT k, x + 1 AS x, y FROM s UNION ALL SELECT k, x, y + 1 FROM s) USING (k, x, y) GROUP BY k)
SELECT k, CAST(COUNT(*) AS DOUBLE) AS area, CAST(4 * COUNT(*) - 2 * COALESCE(MAX(c), 0) AS DOUBLE) AS perimeter FROM s LEFT JOIN n USING (k) GROUP BY k
""")
def dissolved_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions as connected parts, one key holding every box: area and length of the boundary."""
    boxes = _boxes(_parts(spark, sf_dir))
    keyed = boxes.withColumn("k", F.lit("all")).unionByName(boxes.withColumn("k", (F.col("id") % 4).cast("string")))
    parts = D.dissolve_parts(keyed, ["k"], capacity=200)
    return parts.groupBy("k").agg(r6(F.sum(G.st_area("geometry"))).alias("area"), r6(F.sum(G.st_perimeter("geometry"))).alias("perimeter"))


_DRAWN = (2.25, 1.75, 47.5, 33.25)
_SHARE = "RADIANS(LEAST(x1, {2}) - GREATEST(x0, {0}))".format(*_DRAWN)


@query(f"""
SELECT 'N' || n AS location, ROUND(SUM({_SHARE} * ABS({_zone('LEAST(y1, {3})'.format(*_DRAWN))} - {_zone('GREATEST(y0, {1})'.format(*_DRAWN))})), 2) AS portion_area,
 ROUND(RADIANS({_DRAWN[2]} - {_DRAWN[0]}) * ABS({_zone(str(_DRAWN[3]))} - {_zone(str(_DRAWN[1]))}), 2) AS total_area
FROM (SELECT s_nationkey AS n, s.* FROM ({_SUPPLIERS}) s JOIN supplier ON s_suppkey = id) WHERE x0 < {_DRAWN[2]} AND x1 > {_DRAWN[0]} AND y0 < {_DRAWN[3]} AND y1 > {_DRAWN[1]} GROUP BY 1
""")
def drawn_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn polygon against stored pieces: only the folders of the cells it meets are read."""
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("N"), "s_nationkey").alias("location"))
    path = scratch.folder(spark, "pieces")
    P.store_pieces(_boxes(_suppliers(spark, sf_dir)).join(nations, "id").select("location", "geometry"), path, size=8.0)
    out = P.analyse_stored(spark, path, K.to_wkb(K.box(*_DRAWN)), size=8.0, projection="6933")
    return out.select("location", F.round("portion_area", 2).alias("portion_area"), F.round("total_area", 2).alias("total_area"))


@query(f"""
WITH p AS ({_PARTS}), sea AS (SELECT CAST(s_suppkey AS VARCHAR) AS location, s_suppkey % 83 AS x0, s_suppkey % 79 AS y0, s_suppkey % 83 + 12 AS x1, s_suppkey % 79 + 9 AS y1 FROM supplier),
u AS (SELECT x, y, MAX(id % 3 = 0) AS pa, COUNT(*) AS n FROM p, range(0, 110) i(x), range(0, 100) j(y) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2),
a AS (SELECT location, COUNT(*) AS cells, COUNT(*) FILTER (pa) AS pa FROM sea JOIN u ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1),
n AS (SELECT location, COUNT(*) AS n FROM sea s JOIN p ON p.x0 < s.x1 AND s.x0 < p.x1 AND p.y0 < s.y1 AND s.y0 < p.y1 GROUP BY 1)
SELECT location, COALESCE(cells, 0)::DOUBLE AS protected_area, COALESCE(n, 0) AS protected_areas_count, round_even(COALESCE(cells, 0) / 108.0::DOUBLE * 100, 2) AS coverage,
 round_even(COALESCE(pa / cells::DOUBLE * 100, 0), 2) AS pas, round_even(CASE WHEN cells > 0 THEN 100 - pa / cells::DOUBLE * 100 ELSE 0 END, 2) AS oecms, 108.0::DOUBLE AS total_area
FROM sea LEFT JOIN a USING (location) LEFT JOIN n USING (location)
""")
def sea_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected share of seas (a box for each supplier, in kilometres): overlapping areas count once, seas
    without any have zeros."""
    k = F.col("s_suppkey")
    x, y = (k % 83) * 1000.0, (k % 79) * 1000.0
    seas = table(spark, sf_dir, "supplier").select(k.alias("MRGID"), G.st_box(x, y, x + 12_000.0, y + 9_000.0).alias("geometry"))
    areas = _parts(spark, sf_dir).select((F.col("id") % 3 == 0).cast("int").alias("PA_DEF"), G.st_box(*[F.col(c) * 1000.0 for c in ("x0", "y0", "x1", "y1")]).alias("geometry"))
    return J.sea_coverage(seas, areas, projected=True, size=8000.0).drop("environment", "global_contribution")


_COLUMN = "8 - CASE WHEN (s_suppkey + 1) % 3 = 0 THEN 0.8 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 0.8 ELSE 0 END"


@query(f"""
SELECT s_suppkey AS id, ROUND(({_COLUMN})::DOUBLE, 6) AS area, CAST(5 + CASE WHEN (s_suppkey + 1) % 3 = 0 THEN 7 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 7 ELSE 0 END AS BIGINT) AS points FROM supplier
""")
def simplified_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns side by side whose common borders waver, every third one by more than the tolerance: borders
    are simplified once and stay common."""
    k = F.col("s_suppkey")
    line = lambda at: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda j: F.struct((at - (j % 2) * F.when(at % 3 == 0, 0.2).otherwise(0.01)).alias("x"), j.cast("double").alias("y")))
    ring = F.concat(line(k + 1), F.reverse(line(k)), F.slice(line(k + 1), 1, 1))
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    shapes = table(spark, sf_dir, "supplier").select(k.alias("id"), G.st_from_geojson(F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")))).alias("geometry"))
    out = T.simplify_shared(shapes, 0.05)
    return out.select("id", r6(G.st_area("geometry")).alias("area"), G.st_points("geometry").alias("points"))
