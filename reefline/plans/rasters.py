"""Raster queries on driver tables: parts are pixels, suppliers' boxes are locations' zones (by nation, they
overlap), customers' boxes are protected areas. SQL counts pixels one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.geo import functions as G
from reefline.plans.catalog import query, table
from reefline.plans.geometry import _zone
from reefline.raster import spans as S
from reefline.raster import zonal as Z

ROWS, COLS = 50, 1 << 20
_GRID = Z.Transform(0.1, -0.1, -20.0, 20.0)
_CLASSES = {0: "other corals", 1: "resilient corals", 2: "reef flat"}

_PIXELS = f"SELECT p_partkey % {ROWS} AS r, p_partkey // {ROWS} AS c, p_size % 4 AS v FROM part"
_ZONES = f"SELECT 'N' || s_nationkey AS location, s_suppkey % 41 AS r0, s_suppkey % 41 + 9 AS r1, s_suppkey % 37 + 40 * (s_suppkey // 37) AS c0, s_suppkey % 37 + 40 * (s_suppkey // 37) + 7 AS c1 FROM supplier"
_AREAS = "SELECT 'N' || c_nationkey AS location, c_custkey % 47 AS r0, c_custkey % 47 + 3 AS r1, c_custkey % 43 + 20 * (c_custkey // 400) AS c0, c_custkey % 43 + 20 * (c_custkey // 400) + 2 AS c1 FROM customer"
_UNDER = "p.r BETWEEN {0}.r0 AND {0}.r1 AND p.c BETWEEN {0}.c0 AND {0}.c1"
_KM2 = f"ABS({_zone('20 - 0.1 * r')} - {_zone('20 - 0.1 * (r + 1)')}) * RADIANS(0.1)"
_CLASS = "CASE v WHEN 0 THEN 'other corals' WHEN 1 THEN 'resilient corals' WHEN 2 THEN 'reef flat' ELSE 'class_3' END"


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((k % ROWS).cast("long").alias("row"), F.floor(k / ROWS).cast("long").alias("col"), (F.col("p_size") % 4).cast("int").alias("value"))


def _spans(df: DataFrame, nation: str, key: str, rows: int, columns: int, step: int, every: int, height: int, width: int) -> DataFrame:
    """Runs of the polygons of boxes that are given by pixels."""
    k = F.col(key)
    row, col = k % rows, k % columns + step * F.floor(k / every)
    x0, y1 = _GRID.c + _GRID.a * col, _GRID.f + _GRID.e * row
    box = G.st_box(x0, y1 + _GRID.e * height, x0 + _GRID.a * width, y1)
    return Z.spans(df.select(F.concat(F.lit("N"), nation).alias("location"), box.alias("geometry")), _GRID, ROWS, COLS)


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", 41, 37, 40, 37, 10, 8)


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", 47, 43, 20, 400, 4, 3)


@query(f"""
WITH p AS ({_PIXELS}), z AS ({_ZONES}), hit AS (SELECT DISTINCT location, r, c, v FROM p JOIN z ON {_UNDER.format('z')} WHERE v <> 0)
SELECT location, {_CLASS} AS class, ROUND(SUM({_KM2}), 3) AS area_km2 FROM hit GROUP BY 1, 2
""")
def zonal_class_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class areas of a raster under polygons: a location's overlapping shapes count a pixel once."""
    out = S.class_areas_under(_raster(spark, sf_dir), _zones(spark, sf_dir), _GRID, _CLASSES)
    return out.select("location", "class", F.round("area_km2", 3).alias("area_km2"))


@query(f"""
WITH p AS (SELECT r, c, v, {_KM2} AS km2 FROM ({_PIXELS})), z AS ({_ZONES}), a AS ({_AREAS}),
hit AS (SELECT DISTINCT z.location, r, c, v, km2 FROM p JOIN z ON {_UNDER.format('z')}),
held AS (SELECT DISTINCT a.location, r, c, true AS held FROM p JOIN a ON {_UNDER.format('a')})
SELECT location, {_CLASS} AS class, ROUND(SUM(km2), 3) AS total_area, ROUND(SUM(CASE WHEN held THEN km2 ELSE 0 END), 3) AS protected_area
FROM hit LEFT JOIN held USING (location, r, c) GROUP BY 1, 2
""")
def class_areas_in_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class areas under locations, and under the union of their own protected areas within them."""
    raster, zones = _raster(spark, sf_dir), _zones(spark, sf_dir)
    total = S.class_areas_under(raster, zones, _GRID, _CLASSES, include_zero=True)
    held = S.class_areas_under(raster, zones, _GRID, _CLASSES, _areas(spark, sf_dir), include_zero=True).withColumnRenamed("area_km2", "protected_area")
    both = total.join(held, ["location", "class"], "left")
    return both.select("location", "class", F.round("area_km2", 3).alias("total_area"), F.round(F.coalesce("protected_area", F.lit(0.0)), 3).alias("protected_area"))


def _passes(location: str) -> str:
    """The class areas of zones and of their protected part as two passes of their own."""
    return f"""
SELECT location, v, SUM(km2) AS total, 0.0 AS held FROM (SELECT DISTINCT {location} AS location, r, c, v, km2 FROM p JOIN z ON {_UNDER.format('z')}) GROUP BY 1, 2
UNION ALL SELECT location, v, 0.0, SUM(km2) FROM (SELECT DISTINCT {location} AS location, r, c, v, km2 FROM p JOIN z ON {_UNDER.format('z')} JOIN a ON {_UNDER.format('a')}) GROUP BY 1, 2"""


@query(f"""
WITH p AS (SELECT r, c, v, {_KM2} AS km2 FROM ({_PIXELS})), z AS ({_ZONES}), a AS ({_AREAS}), each AS ({_passes('z.location')} UNION ALL {_passes("'GLOB'")})
SELECT location, {_CLASS} AS class, ROUND(SUM(total), 3) AS total_area, ROUND(SUM(held), 3) AS protected_area FROM each GROUP BY 1, 2
""")
def coral_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes under overlapping claims in one pass: a pixel counts for each claimant and once for the world."""
    out = S.claimed_class_areas(_raster(spark, sf_dir), _zones(spark, sf_dir), _areas(spark, sf_dir), _GRID, _CLASSES)
    return out.select("location", "class", F.round("total_area", 3).alias("total_area"), F.round("protected_area", 3).alias("protected_area"))
