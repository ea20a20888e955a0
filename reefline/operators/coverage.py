"""Protection coverage by country, group, sea and globe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.functions.numbers import number, percent, safe_sum, whole
from reefline.operators.clean import add_constants, add_shares, expand_dict
from reefline.operators.groups import rollup

COLUMNS = ["location", "environment", "protected_area", "protected_areas_count", "coverage", "pas", "oecms", "global_contribution", "total_area"]


def country_rows(countries: DataFrame, environment: str) -> DataFrame:
    """One row for each country of a realm ("marine" or "land") from the statistics dict literal."""
    names = {
        f"{environment}_area": "total_area",
        f"oecms_pa_{environment}_area": "protected_area",
        f"percentage_oecms_pa_{environment}_cover": "coverage",
        f"pa_{environment}_area": "pa_protected_area",
        f"percentage_pa_{environment}_cover": "pa_coverage",
    }
    counts = [f"{kind}_{shape}_count" for kind in ("protected_area", "oecm") for shape in ("polygon", "point")]
    rows = countries.select(F.col("id").alias("location"), F.col("pas_count").alias("protected_areas_count"), "statistics")
    rows = add_constants(rows, {"environment": "terrestrial" if environment == "land" else environment})
    return add_shares(expand_dict(rows, "statistics", names | {c: c for c in counts})).drop("statistics", *counts)


def key_values(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key/value statistics (type, value) as one row with a column for each key; blank values are null.
    ``rows`` is a few lines of one published file."""
    return rows.groupBy().agg(*[F.max(F.when(F.col("type") == k, number("value"))).alias(k) for k in keys])


def global_area(environment: str) -> Column:
    """The whole area implied by what is protected and its percentage."""
    place = "ocean" if environment == "marine" else "land"
    return F.try_divide(F.col(f"total_{place}_area_oecms_pas"), F.col(f"total_{place}_oecms_pas_coverage_percentage") / 100)


def group_rows(countries: DataFrame, groups: DataFrame, world: DataFrame | None, environment: str, percent_type: str = "area") -> DataFrame:
    """Groups of countries. ``percent_type``: whether shares come from summed percentages or from counts.
    Groups without protected area are left out."""
    sums = [safe_sum(c).alias(c) for c in ("total_area", "protected_area", "coverage", "pa_coverage", "pas_count", "oecm_count")]
    sums.append(F.sum("protected_areas_count").cast("long").alias("protected_areas_count"))
    grouped = rollup(countries, groups.where("grp <> 'GLOB'"), "location", sums)
    if percent_type == "area":
        pas = F.when(F.col("coverage") > 0, 100 * F.col("pa_coverage") / F.col("coverage")).otherwise(0.0)
        oecms = F.when(F.col("coverage") > 0, 100 - pas).otherwise(0.0)
    elif percent_type == "counts":
        pas = percent("pas_count", F.col("pas_count") + F.col("oecm_count"))
        oecms = percent("oecm_count", F.col("pas_count") + F.col("oecm_count"))
    else:
        raise ValueError("percent_type is 'area' or 'counts'")
    whole_area = F.lit(None).cast("double")
    if world is not None:
        grouped = grouped.crossJoin(F.broadcast(world.select(global_area(environment).alias("_world"))))  # one row
        whole_area = F.col("_world")
    return grouped.where("protected_area > 0").select(
        "location",
        F.lit(environment).alias("environment"),
        "protected_area",
        "protected_areas_count",
        percent("protected_area", F.nullif("total_area", F.lit(0.0))).alias("coverage"),
        pas.alias("pas"),
        oecms.alias("oecms"),
        percent("protected_area", whole_area).alias("global_contribution"),
        "total_area",
    )


def world_rows(world: DataFrame, environment: str) -> DataFrame:
    """The global row and, at sea, the high-seas row (whose count is -9999: not known)."""
    place = "ocean" if environment == "marine" else "land"
    both, other = F.col(f"total_{place}_area_oecms_pas"), F.col(f"total_{place}_area_oecms")
    covered = F.col(f"total_{place}_oecms_pas_coverage_percentage")
    row = world.select(
        F.lit("GLOB").alias("location"),
        F.lit(environment).alias("environment"),
        both.alias("protected_area"),
        F.col(f"total_{environment}_oecms_pas").cast("long").alias("protected_areas_count"),
        covered.alias("coverage"),
        percent(both - other, both).alias("pas"),
        percent(other, both).alias("oecms"),
        covered.alias("global_contribution"),
        global_area(environment).alias("total_area"),
    )
    if environment != "marine":
        return row
    area = F.col("high_seas_pa_coverage_area")
    other = F.col("total_ocean_area_oecms") - F.col("national_waters_oecms_coverage_area")
    both = F.col("total_ocean_area_oecms_pas") - F.col("national_waters_oecms_pas_coverage_area")
    high = world.select(
        F.lit("ABNJ").alias("location"),
        F.lit(environment).alias("environment"),
        area.alias("protected_area"),
        F.lit(-9999).cast("long").alias("protected_areas_count"),
        F.col("high_seas_pa_coverage_percentage").alias("coverage"),
        percent(both - other, both).alias("pas"),
        percent(other, both).alias("oecms"),
        percent(area, global_area(environment)).alias("global_contribution"),
        (global_area(environment) * F.col("global_ocean_percentage") / 100).alias("total_area"),
    )
    return row.unionByName(high)


#: The keys of the world's statistics.
WORLD_KEYS = [
    "total_ocean_area_oecms_pas", "total_ocean_area_oecms", "total_ocean_oecms_pas_coverage_percentage", "total_marine_oecms_pas",
    "total_land_area_oecms_pas", "total_land_area_oecms", "total_land_oecms_pas_coverage_percentage", "total_terrestrial_oecms_pas",
    "high_seas_pa_coverage_area", "high_seas_pa_coverage_percentage", "national_waters_oecms_coverage_area",
    "national_waters_oecms_pas_coverage_area", "global_ocean_percentage",
]


def coverage_table(countries: DataFrame, world_values: DataFrame, groups: DataFrame, seas: DataFrame | None = None, percent_type: str = "area") -> tuple[DataFrame, DataFrame]:
    """(coverage table, areas of the groups): both realms, globe, high seas and, if given, the sea rows."""
    world = key_values(world_values, WORLD_KEYS)
    parts = [group_rows(country_rows(countries, realm), groups, world, environment, percent_type) for realm, environment in (("land", "terrestrial"), ("marine", "marine"))]
    table = parts[0].unionByName(parts[1]).where("total_area > 0")
    areas = table.select("location", "environment", "total_area")
    for environment in ("marine", "terrestrial"):
        table = table.unionByName(world_rows(world, environment))
    if seas is not None:
        table = table.unionByName(seas, allowMissingColumns=True)
    return table.withColumn("total_area", whole("total_area")), areas
