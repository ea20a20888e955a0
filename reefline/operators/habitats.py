"""Habitat tables: total and protected area of each habitat by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.functions.numbers import number, safe_sum
from reefline.operators.clean import known_habitats
from reefline.operators.groups import rollup, total

COLUMNS = ["location", "habitat", "environment", "protected_area", "total_area"]


def _shaped(df: DataFrame, habitat: Column, environment: str = "marine") -> DataFrame:
    return df.select("location", habitat.alias("habitat"), F.lit(environment).alias("environment"), "protected_area", "total_area")


def all_groups(groups: DataFrame) -> DataFrame:
    return groups.select(F.col("grp").alias("location")).distinct()


def seamounts(by_zone: DataFrame, by_area: DataFrame, peaks: DataFrame, groups: DataFrame) -> DataFrame:
    """Each peak counts once in a group, however many of the group's zones it touches.

    ``by_zone`` and ``by_area`` hold (PEAKID, AREA2D, location) of peaks in zones and in protected areas.
    All groups have a row; the globe's total is that of all peaks.
    """
    one = lambda df: rollup(df, groups, "location", [F.collect_set(F.lit(1))], by=["PEAKID", "AREA2D"]).groupBy("location").agg(safe_sum("AREA2D").alias("area"))
    world = total(by_area.select("PEAKID", "AREA2D").distinct(), "GLOB", [safe_sum("AREA2D").alias("area")])
    protected = one(by_area).where("location <> 'GLOB'").unionByName(world)
    everything = one(by_zone).where("location <> 'GLOB'").unionByName(total(peaks, "GLOB", [safe_sum("AREA2D").alias("area")]))
    rows = all_groups(groups).join(everything.withColumnRenamed("area", "total_area"), "location", "left").join(protected.withColumnRenamed("area", "protected_area"), "location", "left")
    rows = rows.select("location", F.coalesce("total_area", F.lit(0.0)).alias("total_area"), F.coalesce("protected_area", F.lit(0.0)).alias("protected_area"))
    return _shaped(rows.withColumn("protected_area", F.least("protected_area", "total_area")), F.lit("seamounts"))


def by_location(stats: DataFrame, groups: DataFrame, habitat: str, total_col: str, protected_col: str, world_total: float | None = None) -> DataFrame:
    """One habitat summed over groups that have any; the globe's total may come from elsewhere."""
    sums = [safe_sum(total_col).alias("total_area"), safe_sum(protected_col).alias("protected_area")]
    rows = rollup(stats, groups.where("grp <> 'GLOB'"), "location", sums)
    world = total(stats, "GLOB", sums)
    if world_total is not None:
        world = world.withColumn("total_area", F.lit(float(world_total)))
    return _shaped(rows.unionByName(world).where("total_area > 0"), F.lit(habitat))


def listed(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Every habitat for every group, from rows (ISO3, habitat, total_area, protected_area) whose numbers
    may be "-"."""
    rows = files.select("ISO3", "habitat", number("total_area").alias("total_area"), number("protected_area").alias("protected_area"))
    sums = [safe_sum("total_area").alias("total_area"), safe_sum("protected_area").alias("protected_area")]
    grouped = rollup(rows, groups.where("grp <> 'GLOB'"), "ISO3", sums, by=["habitat"], keep_empty=True)
    world = total(rows, "GLOB", sums, by=["habitat"])
    return _shaped(grouped.unionByName(world), F.col("habitat"))


def melted(stats: DataFrame, classes: Sequence[str], value: str) -> DataFrame:
    """One row for each location and class column."""
    return stats.unpivot("location", list(classes), "habitat", value)


def corals(total_stats: DataFrame, protected_stats: DataFrame, groups: DataFrame, classes: Sequence[str], world_total: dict[str, float] | None = None, world_protected: dict[str, float] | None = None) -> DataFrame:
    """Class areas of all groups. Reefs under overlapping claims count for each claimant, so the globe
    takes areas computed apart where they are given."""
    spark = total_stats.sparkSession

    def grouped(stats: DataFrame, name: str, world: dict[str, float] | None) -> DataFrame:
        have = [c for c in classes if c in stats.columns]
        rows = melted(stats, have, name) if have else spark.createDataFrame([], f"location string, habitat string, {name} double")
        out = rollup(rows, groups.where("grp <> 'GLOB'"), "location", [safe_sum(name).alias(name)], by=["habitat"])
        if world_total is None and world_protected is None:
            return out.unionByName(total(rows, "GLOB", [safe_sum(name).alias(name)], by=["habitat"]))
        return out.unionByName(spark.createDataFrame([("GLOB", c, float((world or {}).get(c, 0.0))) for c in classes], f"location string, habitat string, {name} double"))

    kinds = spark.createDataFrame([(c,) for c in classes], "habitat string")
    rows = all_groups(groups).crossJoin(F.broadcast(kinds))  # a handful of classes
    for name, stats, world in (("total_area", total_stats, world_total), ("protected_area", protected_stats, world_protected)):
        rows = rows.join(grouped(stats, name, world), ["location", "habitat"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return _shaped(rows, F.col("habitat"))


def land_cover(total_stats: DataFrame, protected_stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Classes of land cover: columns of both tables summed over groups and turned into rows. A class that
    only the totals have keeps a null protected area and environment."""

    def grouped(stats: DataFrame, name: str) -> DataFrame:
        classes = [c for c in stats.columns if c != "location"]
        numbers = stats.select("location", *[number(f"`{c}`").alias(c) for c in classes])
        sums = [safe_sum(f"`{c}`").alias(c) for c in classes]
        rows = rollup(numbers, groups.where("grp <> 'GLOB'"), "location", sums, keep_empty=True).unionByName(total(numbers, "GLOB", sums))
        return melted(rows, classes, name).withColumn("habitat", F.when(F.col("habitat") == "total", "total_land_area").otherwise(F.col("habitat")))

    protected = grouped(protected_stats, "protected_area").withColumn("environment", F.lit("terrestrial"))
    return grouped(total_stats, "total_area").join(protected, ["location", "habitat"], "left").select(*COLUMNS)


def habitat_table(*parts: DataFrame) -> DataFrame:
    """All habitats under their public names, with a total above 0."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return known_habitats(out.where("total_area > 0"))
