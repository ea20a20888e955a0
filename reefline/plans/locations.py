"""Locations, sites, mangroves and relations over driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.geo import functions as G
from reefline.geo import joins as J
from reefline.operators import diff
from reefline.operators import zones as O
from reefline.plans.catalog import query, r6, spread, table
from reefline.plans.geometry import _PARTS, _SUPPLIERS, _boxes, _parts, _suppliers, _zone
from reefline.plans.rasters import _CLASSES, _GRID, _KM2, _PIXELS, _UNDER, _ZONES, _raster, _zones
from reefline.raster import spans as S
from reefline.raster import zonal as Z
from reefline.sources import readers, scratch, writers


@query(f"""
WITH p AS ({_PARTS}), l AS (SELECT 'S' || id AS location, s.* FROM ({_SUPPLIERS}) s),
h AS (SELECT x / 2.0 AS x, y / 2.0 AS y, MAX(id % 4 = 0) AS held FROM p, range(0, 220) i(x), range(0, 200) j(y) WHERE x / 2.0 >= x0 AND x / 2.0 < x1 AND y / 2.0 >= y0 AND y / 2.0 < y1 GROUP BY 1, 2),
a AS (SELECT location, held, RADIANS(0.5) * ABS({_zone('y + 0.5')} - {_zone('y')}) AS km2 FROM h JOIN l ON x >= x0 AND x < x1 AND y >= y0 AND y < y1)
SELECT location, ROUND(SUM(km2), 2) AS total, ROUND(SUM(CASE WHEN held THEN km2 ELSE 0 END), 2) AS held FROM a GROUP BY location
""")
def mangrove_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping mangroves (boxes of parts) by location, and what of them lies in areas (every fourth box)."""
    woods = _boxes(_parts(spark, sf_dir))
    zones = _boxes(_suppliers(spark, sf_dir)).select(F.concat(F.lit("S"), "id").alias("location"), "geometry")
    out = O.mangroves_by_location(woods, zones, woods.where("id % 4 = 0"), 8.0)
    return out.select("location", F.round("total_mangrove_area_km2", 2).alias("total"), F.round("protected_mangrove_area_km2", 2).alias("held"))


@query("""
SELECT c_custkey AS id, CASE WHEN FLOOR(c_acctbal / 100) > 0 THEN FLOOR(c_acctbal / 100) ELSE 10 + c_custkey % 5 END::DOUBLE AS km2 FROM customer
""")
def site_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that are points get the shape of their own area: mapped if positive, else reported."""
    k = F.col("c_custkey")
    sites = spread(table(spark, sf_dir, "customer"), "c_custkey").select(
        k.alias("id"), F.floor(F.col("c_acctbal") / 100).cast("string").alias("GIS_AREA"), (10 + k % 5).cast("string").alias("REP_AREA"), G.st_point((k % 170).cast("double"), (k % 60 - 30).cast("double")).alias("geometry")
    )
    return O.site_geometries(sites).select("id", F.round(G.st_area_km2("geometry"), 1).alias("km2"))


@query(f"""
WITH p AS ({_PIXELS}), z AS ({_ZONES}), a AS (SELECT location, v, SUM({_KM2}) AS km2 FROM (SELECT DISTINCT location, r, c, v FROM p JOIN z ON {_UNDER.format('z')}) GROUP BY 1, 2)
SELECT location, ROUND(COALESCE(SUM(km2) FILTER (v = 0), 0), 3) AS other_corals, ROUND(COALESCE(SUM(km2) FILTER (v = 1), 0), 3) AS resilient_corals, ROUND(COALESCE(SUM(km2) FILTER (v = 2), 0), 3) AS reef_flat,
 ROUND(COALESCE(SUM(km2) FILTER (v < 3), 0), 3) AS total FROM a GROUP BY location
""")
def wide_class_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each class, 0 where a location has none, and their total."""
    out = Z.wide_areas(S.class_areas_under(_raster(spark, sf_dir), _zones(spark, sf_dir), _GRID, _CLASSES, include_zero=True), list(_CLASSES.values()))
    return out.select("location", *[F.round(F.col(f"`{c}`"), 3).alias(c.replace(" ", "_")) for c in [*_CLASSES.values(), "total"]])


@query(f"""
WITH p AS (SELECT id % 300 AS k, p.* FROM ({_PARTS}) p), s AS (SELECT DISTINCT k, x, y FROM p, range(0, 110) i(x), range(0, 100) j(y) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1)
SELECT k, CAST(COUNT(*) AS DOUBLE) AS area FROM s GROUP BY k
""")
def dissolved_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of several rows are dissolved, those of one row stay as they are."""
    boxes = _boxes(_parts(spark, sf_dir)).select((F.col("id") % 300).alias("k"), "geometry")
    return J.dissolve_repeated(boxes, "k").select("k", r6(G.st_area("geometry")).alias("area"))


@query("""
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem),
a AS (SELECT o, list(DISTINCT n ORDER BY n) AS old, list(DISTINCT n ORDER BY n) FILTER (n <> 3) AS new, max(CASE WHEN n = 1 THEN p END) AS parent FROM l GROUP BY o)
SELECT o AS id, CASE WHEN o % 7 = 0 THEN true WHEN new IS NULL THEN true ELSE old <> new END AS children, CASE WHEN parent IS NULL THEN o % 2 = 0 ELSE o % 2 = 1 AND parent % 2 = 1 END AS parent FROM a
""")
def relation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record's list of children and its parent differ from the stored ones: lists that lose an
    element, are gone or hold one without an id; parents that change or appear."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))  # noqa: E741
    a = l.groupBy("o").agg(F.collect_set("n").alias("old"), F.collect_set(F.when(F.col("n") != 3, F.col("n"))).alias("new"), F.max(F.when(F.col("n") == 1, F.col("p"))).alias("parent"))
    children = lambda c: F.transform(c, lambda n: F.struct(n.cast("long").alias("documentId")))
    new = F.when(F.col("o") % 7 == 0, F.array(F.struct(F.lit(None).cast("long").alias("documentId")))).when(F.size("new") > 0, children("new"))
    one = lambda c: F.when(c.isNotNull(), F.struct(c.cast("long").alias("documentId")))
    now = F.coalesce(F.when((F.col("o") % 2 == 1) & (F.col("parent") % 2 == 1), F.col("parent") + 1).otherwise(F.col("parent")), F.when(F.col("o") % 2 == 0, F.lit(1)))
    return a.select(F.col("o").alias("id"), diff.children_changed(children("old"), new).alias("children"), diff.parent_changed(one(F.col("parent")), one(now)).alias("parent"))


@query("""SELECT c_mktsegment AS habitat, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS total FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
def tagged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one kind of table each, read as one with their tags."""
    c, paths = table(spark, sf_dir, "customer"), {}
    for segment in ("BUILDING", "MACHINERY"):
        paths[segment] = scratch.folder(spark, f"tagged-{segment}")
        writers.write_csv(c.where(F.col("c_mktsegment") == segment).select("c_custkey", "c_acctbal"), paths[segment])
    return readers.read_tagged(spark, paths, "c_custkey long, c_acctbal double").groupBy("habitat").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query(f"""
WITH p AS ({_PARTS}), sea AS (SELECT CAST(s_suppkey AS VARCHAR) AS location, s_suppkey % 83 AS x0, s_suppkey % 79 AS y0, s_suppkey % 83 + 12 AS x1, s_suppkey % 79 + 9 AS y1 FROM supplier),
u AS (SELECT DISTINCT x, y FROM p, range(0, 110) i(x), range(0, 100) j(y) WHERE id % 3 = 1 AND x >= x0 AND x < x1 AND y >= y0 AND y < y1)
SELECT location, CAST(COUNT(*) AS DOUBLE) AS area, 'highly' AS fishing_protection_level, ROUND(COUNT(*) / 108.0::DOUBLE * 100, 6) AS pct, 108.0::DOUBLE AS total_area FROM sea JOIN u ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY location
""")
def sea_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each sea under sites of one level; overlapping sites count once, seas without any are absent."""
    k = F.col("s_suppkey")
    x, y = (k % 83) * 1000.0, (k % 79) * 1000.0
    seas = table(spark, sf_dir, "supplier").select(k.alias("MRGID"), F.lit(108.0).alias("total_area"), G.st_box(x, y, x + 12_000.0, y + 9_000.0).alias("geometry"))
    sites = _parts(spark, sf_dir).where("id % 3 = 1").select(G.st_box(*[F.col(c) * 1000.0 for c in ("x0", "y0", "x1", "y1")]).alias("geometry"))
    return J.sea_level(seas, sites, "highly", size=8000.0).select("location", r6("area").alias("area"), "fishing_protection_level", r6("pct").alias("pct"), "total_area")
