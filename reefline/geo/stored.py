"""Stored pieces for the analysis of drawn polygons.

Shapes are cut at the cells of a grid, so each piece lies in one cell, and stored in folders by cell. A drawn
polygon is a value: the cells it meets become a condition on the folders, so a reader opens those of its
neighbourhood only, however large the table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.geo import kernel as K
from reefline.geo.functions import PROJECTIONS, st_area, st_area_km2, st_intersection, st_subdivide, st_tiles


def store_pieces(shapes: DataFrame, path: str, *, size: float = 10.0, most: int = 10_000) -> None:
    """(columns, geometry) as pieces of at most ``most`` vertices in folders by cell of ``size``.

    Rows are dealt by cell before they are written, so a cell has few files; a crowded cell is split.
    """
    rest = [c for c in shapes.columns if c != "geometry"]
    tiles = shapes.select(*rest, F.explode(st_tiles("geometry", size)).alias("_t"))
    pieces = tiles.select(*rest, F.col("_t.i").alias("cell_x"), F.col("_t.j").alias("cell_y"), F.explode(st_subdivide("_t.part", most)).alias("geometry"))
    pieces.hint("rebalance", "cell_x", "cell_y").write.mode("overwrite").partitionBy("cell_x", "cell_y").parquet(path)


def near(spark: SparkSession, path: str, polygon: bytes, *, size: float = 10.0) -> DataFrame:
    """The pieces of the cells that a polygon's shape meets: conditions on the folders' columns alone."""
    cells = sorted({(i, j) for i, j, _ in K.tiles(K.polygons(K.from_wkb(polygon)), size)})
    if not cells:
        raise ValueError("the polygon is empty")
    by_column: dict[int, list[int]] = {}
    for i, j in cells:
        by_column.setdefault(i, []).append(j)
    here = F.lit(False)
    by_rows: dict[tuple[int, ...], list[int]] = {}
    for i, js in by_column.items():
        by_rows.setdefault(tuple(js), []).append(i)
    for js, columns in by_rows.items():
        here = here | (F.col("cell_x").isin(columns) & F.col("cell_y").isin(list(js)))
    return spark.read.parquet(path).where(here)


def analyse_stored(spark: SparkSession, path: str, polygon: bytes, *, size: float = 10.0, projection: str = "mollweide_wgs84", by: str = "location") -> DataFrame:
    """(location, portion_area, total_area): km2 of each location's pieces within a drawn polygon, and of the
    polygon. Pieces of a location are disjoint, so their shares add up; sums are rounded by the caller."""
    part = near(spark, path, polygon, size=size).where(F.col(by).isNotNull()).withColumn("_part", st_intersection("geometry", F.lit(polygon))).where(st_area("_part") > 0)
    total = K.area(K.transform(K.from_wkb(polygon), PROJECTIONS[projection])) / 1e6
    return part.groupBy(by).agg(F.sum(st_area_km2("_part", projection)).alias("portion_area")).withColumn("total_area", F.lit(float(total)))
