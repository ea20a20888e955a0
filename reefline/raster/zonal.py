"""Raster tables and statistics.

A raster is a table (row, col, value) plus one transform (a, e, c, f): pixel corners lie at x = c + a col,
y = f + e row. Everything here is column expressions, except the mask, which turns a polygon into spans of
columns for each row in an Arrow function.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS84 ellipsoid; land-cover classes and their code ranges, the first that fits.
A = 6378137.0
E2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)
LAND_COVER = {1: "Forest", 2: "Savanna", 3: "Shrubland", 4: "Grassland", 5: "Wetlands/open water", 6: "Rocky/mountains", 7: "Desert", 8: "Artificial", 255: "Other"}


@dataclass(frozen=True)
class Transform:
    a: float
    e: float
    c: float
    f: float
    crs: str = "EPSG:4326"


def zone_area(lat: Column) -> Column:
    """Area in km2 between the equator and a latitude (radians), for one radian of longitude."""
    e = math.sqrt(E2)
    s = F.sin(lat)
    return F.lit(A * A * (1 - E2) / 2 / 1e6) * (s / (1 - E2 * s * s) + F.atanh(e * s) / e)


def latitude(y: Column, crs: str) -> Column:
    if crs == "EPSG:4326":
        return F.radians(y)
    if crs == "EPSG:3857":
        return 2 * F.atan(F.exp(y / A)) - math.pi / 2
    raise ValueError(f"pixel areas need EPSG:4326 or EPSG:3857, not {crs}")


def pixel_area(row: Column, t: Transform) -> Column:
    """Area in km2 of the pixels of a row."""
    width = math.radians(abs(t.a)) if t.crs == "EPSG:4326" else abs(t.a) / A
    top, bottom = latitude(F.lit(t.f) + F.lit(t.e) * row, t.crs), latitude(F.lit(t.f) + F.lit(t.e) * (row + 1), t.crs)
    return F.abs(zone_area(top) - zone_area(bottom)) * width


def land_cover_class(code: Column) -> Column:
    """A habitat code as one of eight classes; others as they are, within 0 to 255."""
    between = lambda lo, hi: (code >= lo) & (code < hi)
    return (
        F.when(code < 200, 1).when(between(200, 300), 2).when(between(300, 400), 3).when(between(400, 500), 4)
        .when(between(500, 600) | code.isin(910, 984), 5).when(between(600, 800), 6).when(between(800, 900), 7)
        .when(between(1400, 1500), 8).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), code)))
    )


def ramp(value: Column, stops: Mapping[float, tuple[int, int, int]], nodata: float | None = None) -> Column:
    """Colour (r, g, b, alpha) between the two stops around a value; transparent for nodata and null."""
    at = sorted(stops)
    out = F.struct(*[F.lit(v).alias(n) for v, n in zip((*stops[at[-1]], 255), "rgba", strict=True)])
    for lo, hi in reversed(list(zip(at, at[1:], strict=False))):
        share = (value - lo) / (hi - lo)
        mixed = [F.rint(F.lit(float(x)) + share * (y - x)).cast("int").alias(n) for x, y, n in zip(stops[lo], stops[hi], "rgb", strict=True)]
        out = F.when(value < hi, F.struct(*mixed, F.lit(255).alias("a"))).otherwise(out)
    out = F.when(value <= at[0], F.struct(*[F.lit(v).alias(n) for v, n in zip((*stops[at[0]], 255), "rgba", strict=True)])).otherwise(out)
    clear = F.struct(*[F.lit(0).alias(n) for n in "rgba"])
    return F.when(value.isNull() | F.isnan(value.cast("double")) | (value == F.lit(nodata) if nodata is not None else F.lit(False)), clear).otherwise(out)


def spans(zones: DataFrame, t: Transform, rows: int, cols: int) -> DataFrame:
    """(location, row, col0, col1): runs of pixels whose centres lie in each zone (location, geometry)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from reefline.geo import kernel as K

        for batch in batches:
            out: list[tuple] = []
            for loc, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = K.polygons(K.from_wkb(w)) if w is not None else []
                if not g:
                    continue
                _, y0, _, y1 = K.bounds(g)
                ends = sorted(((y0 - t.f) / t.e, (y1 - t.f) / t.e))
                for r in range(max(0, math.floor(ends[0])), min(rows, math.ceil(ends[1]) + 1)):
                    y = t.f + t.e * (r + 0.5)
                    covered: list[tuple[float, float]] = []
                    for p in g:
                        xs = []
                        for ring in p:
                            (x1, ya), (x2, yb) = ring[:-1].T, ring[1:].T
                            m = (ya > y) != (yb > y)
                            xs.append(x1[m] + (y - ya[m]) * (x2[m] - x1[m]) / (yb[m] - ya[m]))
                        line = np.sort(np.concatenate(xs))
                        covered += list(zip(line[::2], line[1::2], strict=False))
                    runs = []
                    for a, b in covered:
                        lo, hi = sorted(((a - t.c) / t.a, (b - t.c) / t.a))
                        first, last = max(0, math.ceil(lo - 0.5)), min(cols - 1, math.ceil(hi - 0.5) - 1)
                        if first <= last:
                            runs.append((first, last))
                    merged: list[list[int]] = []
                    for a, b in sorted(runs):
                        if merged and a <= merged[-1][1] + 1:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    out += [(loc, r, a, b) for a, b in merged]
            cols_ = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols_, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["location", "row", "col0", "col1"])

    return zones.select("location", "geometry").mapInArrow(cut, "location string, row long, col0 long, col1 long")


def class_areas(raster: DataFrame, mask: DataFrame, t: Transform, classes: Mapping[int, str], nodata: float | None = None, *, include_zero: bool = False, block: int = 256) -> DataFrame:
    """(location, class, area_km2): area of each class of the raster under each zone's spans.

    Pixels and spans meet by row and block of columns, so a wide raster has many keys for each row. Values
    without a name are class_<value>.
    """
    pixels = raster.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    if nodata is not None and not math.isnan(nodata):
        pixels = pixels.where(F.col("value") != F.lit(nodata))
    pixels = pixels.withColumn("_k", F.floor(F.col("col") / block))
    runs = mask.withColumn("_k", F.explode(F.sequence(F.floor(F.col("col0") / block), F.floor(F.col("col1") / block))))
    hit = pixels.join(runs, ["row", "_k"]).where((F.col("col") >= F.col("col0")) & (F.col("col") <= F.col("col1")))
    names = F.create_map(*[F.lit(x) for kv in classes.items() for x in (int(kv[0]), kv[1])])
    label = F.coalesce(F.try_element_at(names, F.col("value").cast("int")), F.concat(F.lit("class_"), F.col("value").cast("int").cast("string")))
    out = hit.groupBy("location", label.alias("class")).agg(F.sum(pixel_area(F.col("row"), t)).alias("area_km2"))
    return out if include_zero else out.where("area_km2 > 0")


def wide_areas(areas: DataFrame, classes: list[str]) -> DataFrame:
    """A column for each class, 0 where a location has none, and their total."""
    wide = areas.groupBy("location").pivot("class", classes).agg(F.sum("area_km2")).na.fill(0.0)
    total = F.lit(0.0)
    for c in classes:
        total = total + F.col(f"`{c}`")
    return wide.withColumn("total", total)


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy tile indices (x, y)."""
    n = 2**zoom
    x = F.floor((lon + 180) / 360 * n)
    phi = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    y = F.floor((1 - F.asinh(F.tan(phi)) / math.pi) / 2 * n)
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("long")
    return clip(x), clip(y)


def tile_bounds(x: Column, y: Column, zoom: int) -> dict[str, Column]:
    n = float(2**zoom)
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * v / n))))
    return {"west": x / n * 360 - 180, "south": lat(y + 1), "east": (x + 1) / n * 360 - 180, "north": lat(y)}


def pixel_count(x0: Column, y0: Column, x1: Column, y1: Column, t: Transform) -> Column:
    """About how many pixels a box covers."""
    return (F.ceil((x1 - x0) / abs(t.a)) * F.ceil((y1 - y0) / abs(t.e))).cast("long")
