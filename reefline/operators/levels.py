"""Marine protection levels and fishing protection levels by group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.functions.numbers import blank_to_null, number, percent, row_sum, safe_sum, whole
from reefline.functions.text import lookup
from reefline.operators.clean import add_level_areas, add_level_percents, add_total_from_percent, merge_codes, resolve_territories, starred
from reefline.operators.groups import rollup

# Columns of each level, and codes that are summed into one location.
LEVELS = {
    "full": ["mpaguide_total_if_km2"],
    "high": ["mpaguide_total_ih_km2"],
    "fully-highly-protected": ["mpaguide_total_if_km2", "mpaguide_total_ih_km2"],
    "light": ["mpaguide_total_il_km2"],
    "minimal": ["mpaguide_total_im_km2"],
    "unknown": ["mpaguide_total_iu_km2", "mpaguide_total_du_km2", "mpaguide_total_pc_km2"],
    "less-protected-unknown": ["mpaguide_total_il_km2", "mpaguide_total_im_km2", "mpaguide_total_iu_km2", "mpaguide_total_du_km2", "mpaguide_total_pc_km2"],
}
FISHING = {"highly": ["lfp5_area", "lfp4_area"], "moderately": ["lfp3_area"], "less": ["lfp2_area", "lfp1_area"]}
FISHING_MERGES = {"SHN": ["ASC", "SHN", "TDC"], "SJM": ["JMY", "SVB"], "FRA": ["NAT", "CPT"]}
FISHING_CODES = {"CRV": "HRV", "OCN": "GLOB"}


def level_table(
    countries: DataFrame,
    world: DataFrame,
    groups: DataFrame,
    *,
    high_seas_area: float | None = None,
    level: str = "fully-highly-protected",
    seas: DataFrame | None = None,
) -> DataFrame:
    """Area and percentage at a protection level by group; the globe comes from its own one-row table."""
    rows = countries.select(
        F.col("id").alias("location"),
        number(blank_to_null(F.col("highly_protected_km2").cast("string"))).alias("protected_area"),
        number(blank_to_null(F.col("highly_protected_percent").cast("string"))).alias("percentage"),
        F.when((F.col("id") == "HS") & F.lit(high_seas_area is not None), F.lit(high_seas_area)).otherwise(number(blank_to_null(F.col("wdpa_marine_km2").cast("string")))).alias("wdpa_marine_km2"),
    )
    rows = add_total_from_percent(starred(rows))
    grouped = rollup(rows, groups.where("grp <> 'GLOB'"), "location", [safe_sum("total_area").alias("total_area"), safe_sum("protected_area").alias("area")])
    columns = [c for c in LEVELS[level] if c in world.columns]
    globe = world.select(F.lit("GLOB").alias("location"), F.col("total_km2").cast("double").alias("total_area"), row_sum(columns).alias("area"))
    has_globe = groups.where("grp = 'GLOB'").select("grp").distinct()
    table = grouped.unionByName(globe.join(has_globe, F.col("location") == F.col("grp"), "left_semi"))
    table = table.select("location", "total_area", "area", F.lit(level).alias("mpaa_protection_level"), percent("area", F.nullif("total_area", F.lit(0.0))).alias("percentage"))
    if seas is not None:
        table = table.unionByName(seas, allowMissingColumns=True)
    return table.where("total_area > 0").withColumn("total_area", whole("total_area"))


def world_levels(record: DataFrame) -> DataFrame:
    """A one-row table from the nested global record: total_km2, and mpaguide_total_<key>_{km2,percent}."""
    entry = record.select(F.explode("mpaguide_status.total").alias("e")).select(F.col("e.key").alias("key"), F.col("e.km2").alias("km2"), F.col("e.percent").alias("percent"))
    wide = entry.groupBy().pivot("key").agg(F.first("km2").alias("km2"), F.first("percent").alias("percent"))
    renamed = wide.select(*[F.col(f"`{c}`").alias(f"mpaguide_total_{c}") for c in wide.columns])
    scalars = [c for c, t in record.dtypes if not t.startswith(("struct", "array", "map"))]
    return record.select(*scalars).crossJoin(renamed)  # a row each


def fishing_table(rows: DataFrame, groups: DataFrame, seas: DataFrame | None = None, levels: Mapping[str, Sequence[str]] = FISHING) -> DataFrame:
    """Area, percentage and total for each level and group. Groups without a row are not assessed."""
    rows = rows.withColumn("iso_sov", lookup("iso_sov", FISHING_CODES, F.col("iso_sov")))
    located = add_level_percents(add_level_areas(resolve_territories(rows), levels), list(levels))
    located = merge_codes(located, FISHING_MERGES)
    long = located.select("location", "total_area", F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"{level}_protected_area").alias("area")) for level in levels])).alias("v"))
    long = long.select("location", "total_area", F.col("v.level").alias("fishing_protection_level"), F.col("v.area").alias("area"))
    grouped = rollup(long, groups, "location", [safe_sum("area").alias("area"), safe_sum("total_area").alias("total_area")], by=["fishing_protection_level"])
    share = percent("area", F.nullif("total_area", F.lit(0.0)))
    table = grouped.select("location", "area", "fishing_protection_level", F.when(share.isNotNull(), F.least(F.lit(100.0), share)).alias("pct"), "total_area")
    if seas is not None:
        table = table.unionByName(seas, allowMissingColumns=True)
    return table.where("total_area > 0").withColumn("total_area", whole("total_area"))
