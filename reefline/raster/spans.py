"""Set algebra of pixels, on runs instead of pixels.

A run is (row, col0, col1), ends included. Runs are cut at tiles of ``width`` columns, and (row, tile) is the
key of everything that follows: the borders of all runs of a key are added up by column and swept in order,
which gives the stretches between two borders and how many runs of each operand lie over them. However many
runs overlap, a key has ``width`` borders at most, so no task holds a raster, a zone or a crowded place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.raster.zonal import Transform, pixel_area

WIDTH = 256


def tiled(runs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The runs cut at tile borders, with a column ``tile``."""
    tile = F.explode(F.sequence(F.floor(F.col("col0") / width), F.floor(F.col("col1") / width)))
    cut = runs.where("col0 <= col1").withColumn("tile", tile)
    return cut.withColumns({"col0": F.greatest(F.col("col0"), F.col("tile") * width), "col1": F.least(F.col("col1"), F.col("tile") * width + (width - 1))})


def swept(operands: Mapping[str, DataFrame], keys: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """(keys, row, tile, col0, col1, n_<operand>): the stretches between borders that lie under any run, and
    how many runs of each operand lie over them. Operands have the columns ``keys``, row, col0 and col1."""
    events = None
    for name, runs in operands.items():
        cut = tiled(runs.select(*keys, "row", "col0", "col1"), width)
        border = F.explode(F.array(F.struct(F.col("col0").alias("at"), F.lit(1).alias("step")), F.struct((F.col("col1") + 1).alias("at"), F.lit(-1).alias("step"))))
        own = cut.select(*keys, "row", "tile", border.alias("b")).select(*keys, "row", "tile", "b.at", *[(F.col("b.step") if n == name else F.lit(0)).alias(f"n_{n}") for n in operands])
        events = own if events is None else events.unionByName(own)
    counts = [f"n_{n}" for n in operands]
    borders = events.groupBy(*keys, "row", "tile", "at").agg(*[F.sum(c).alias(c) for c in counts])
    order = Window.partitionBy(*keys, "row", "tile").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = borders.select(*keys, "row", "tile", F.col("at").alias("col0"), (F.lead("at").over(order) - 1).alias("col1"), *[F.sum(c).over(upto).alias(c) for c in counts])
    any_over = F.lit(False)
    for c in counts:
        any_over = any_over | (F.col(c) > 0)
    return out.where(any_over)


def combined(operands: Mapping[str, DataFrame], condition: str, keys: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """(keys, row, tile, col0, col1): disjoint runs of the pixels for which a SQL condition on the counts
    holds, such as ``n_a > 0 and n_b > 0``; neighbours within a tile are one run."""
    hit = swept(operands, keys, width).where(condition)
    order = Window.partitionBy(*keys, "row", "tile").orderBy("col0")
    begins = F.coalesce(F.col("col0") > F.lag("col1").over(order) + 1, F.lit(True)).cast("int")
    runs = hit.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*keys, "row", "tile", "_run").agg(F.min("col0").alias("col0"), F.max("col1").alias("col1")).drop("_run")


def union(runs: DataFrame, keys: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    return combined({"a": runs}, "n_a > 0", keys, width)


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """Pixels under runs of both operands with equal keys."""
    return combined({"a": a, "b": b}, "n_a > 0 and n_b > 0", keys, width)


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    return combined({"a": a, "b": b}, "n_a > 0 and n_b = 0", keys, width)


def value_runs(raster: DataFrame, nodata: float | None = None, width: int = WIDTH) -> DataFrame:
    """(row, tile, col0, col1, value): neighbouring pixels of equal values as one run; without null, NaN and
    nodata. A pixel that is given twice counts twice."""
    pixels = raster.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    if nodata is not None and nodata == nodata:
        pixels = pixels.where(F.col("value") != F.lit(nodata))
    counted = pixels.groupBy("row", "col", "value").agg(F.count("*").alias("_n")).withColumn("tile", F.floor(F.col("col") / width))
    # Pixels of one value and number that follow one another differ from their rank by the same column.
    rank = F.row_number().over(Window.partitionBy("row", "tile", "value", "_n").orderBy("col"))
    runs = counted.withColumn("_run", F.col("col") - rank).groupBy("row", "tile", "value", "_n", "_run").agg(F.min("col").alias("col0"), F.max("col").alias("col1"))
    return runs.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("row", "tile", "col0", "col1", "value")


def shared(runs: DataFrame, others: DataFrame) -> DataFrame:
    """Runs of both sides (with tiles, disjoint each) that meet, as their common part and both sides' columns."""
    renamed = others.withColumnsRenamed({"col0": "_c0", "col1": "_c1"})
    met = runs.join(renamed, ["row", "tile"]).where("col0 <= _c1 and _c0 <= col1")
    return met.withColumns({"col0": F.greatest("col0", "_c0"), "col1": F.least("col1", "_c1")}).drop("_c0", "_c1")


def run_area(t: Transform) -> Column:
    """Area in km2 of a run."""
    return (F.col("col1") - F.col("col0") + 1) * pixel_area(F.col("row"), t)


def class_of(value: Column, classes: Mapping[int, str]) -> Column:
    names = F.create_map(*[F.lit(x) for kv in classes.items() for x in (int(kv[0]), kv[1])])
    return F.coalesce(F.try_element_at(names, value.cast("int")), F.concat(F.lit("class_"), value.cast("int").cast("string")))


def class_areas_under(
    raster: DataFrame,
    zones: DataFrame,
    t: Transform,
    classes: Mapping[int, str],
    areas: DataFrame | None = None,
    *,
    nodata: float | None = None,
    include_zero: bool = False,
    width: int = WIDTH,
) -> DataFrame:
    """(location, class, area_km2) of a raster under the union of each location's runs (location, row, col0,
    col1), or where ``areas`` is given, under that part of it that lies under the union of its areas' runs.

    A location without pixels, and one without areas where those are asked for, has no rows. Pixels of value
    0 count only with ``include_zero``. Values without a name are class_<value>.
    """
    runs = value_runs(raster, nodata, width)
    if not include_zero:
        runs = runs.where("value <> 0")
    mask = union(zones, ["location"], width) if areas is None else intersection(zones, areas, ["location"], width)
    met = shared(runs, mask)
    return met.groupBy("location", class_of(F.col("value"), classes).alias("class")).agg(F.sum(run_area(t)).alias("area_km2"))


def claimed(zones: DataFrame, areas: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row, tile, col0, col1, locations, protected): stretches under zones (location, row, col0, col1), each
    with the sorted locations that claim it and whether an area (row, col0, col1) lies over it; disjoint.

    One sweep gives the borders of all zones and areas; a zone's runs are then spread over the stretches.
    """
    stretches = swept({"zone": zones, "area": areas}, (), width).where("n_zone > 0")
    own = union(zones, ["location"], width)
    spread = shared(stretches, own)
    return spread.groupBy("row", "tile", "col0", "col1", (F.col("n_area") > 0).alias("protected")).agg(F.array_sort(F.collect_set("location")).alias("locations"))


def claimed_class_areas(raster: DataFrame, zones: DataFrame, areas: DataFrame, t: Transform, classes: Mapping[int, str], *, nodata: float | None = None, world: str = "GLOB", width: int = WIDTH) -> DataFrame:
    """(location, class, total_area, protected_area) where zones may overlap, in one pass over the raster.

    A pixel counts for each location that claims it, and once for ``world`` if any does. Pixels of value 0
    are a class of their own. Sums are made by set of claimants before these are taken apart.
    """
    met = shared(value_runs(raster, nodata, width), claimed(zones, areas, width))
    sums = met.groupBy("locations", "protected", class_of(F.col("value"), classes).alias("class")).agg(F.sum(run_area(t)).alias("area"))
    each = sums.withColumn("location", F.explode(F.concat(F.col("locations"), F.array(F.lit(world)))))
    protected = F.sum(F.when(F.col("protected"), F.col("area")).otherwise(0.0))
    return each.groupBy("location", "class").agg(F.sum("area").alias("total_area"), protected.alias("protected_area"))
