"""Preparing zones: shared zones given to each claimant, the locations table, site geometries, mangroves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.functions.numbers import number, whole
from reefline.geo.functions import st_area_km2, st_bounds, st_buffer_km2, st_intersection, st_repaired, st_simplify, st_union_agg
from reefline.geo.joins import covered, dissolve, spatial_join, united, united_cells
from reefline.operators.clean import choose_area, claimants
from reefline.operators.groups import members, membership


def by_claimant(zones: DataFrame, territories: Sequence[str], sovereigns: Sequence[str], rollups: Sequence[str], area: str = "AREA_KM2") -> DataFrame:
    """(location, AREA_KM2, has_shared_marine_area, geometry): a shared zone counts whole for each claimant.

    Areas are summed per claimant, except for roll-ups, whose zones may overlap: theirs are null, to be
    measured from the united shape.
    """
    own = zones.withColumn("_all", claimants(territories, sovereigns, rollups))
    plain = F.size(F.filter("_all", lambda c: ~F.endswith(c, F.lit("*")))) > 1
    rows = own.select(F.explode("_all").alias("location"), number(area).alias("_area"), plain.alias("_shared"), "geometry")
    numbers = rows.groupBy("location").agg(F.sum("_area").alias("_sum"), F.bool_or("_shared").alias("has_shared_marine_area"))
    shapes = dissolve(rows, ["location"])
    total = F.when(~F.endswith(F.col("location"), F.lit("*")), F.col("_sum"))
    return numbers.join(shapes, "location").select("location", total.alias("AREA_KM2"), "has_shared_marine_area", "geometry")


def with_group_rows(zones: DataFrame, groups: DataFrame, kind: str) -> DataFrame:
    """Zones (code, geometry, ...) with a row for each group that has any, of united shape, and with the
    members' group lists."""
    lists = membership(groups)
    own = zones.join(lists, zones["code"] == lists["member"], "left").drop("member")
    shapes = united(zones.join(groups, zones["code"] == groups["member"]).select("grp", "geometry"), ["grp"])
    rows = shapes.join(members(groups), "grp").select(F.col("grp").alias("code"), "geometry", F.lit(kind).alias("type"), "members")
    return own.withColumn("type", F.lit("country")).unionByName(rows, allowMissingColumns=True)


def bounds_list(geometry: str = "geometry") -> Column:
    b = st_bounds(geometry)
    return F.array(*[F.bround(b[c], 5) for c in ("minx", "miny", "maxx", "maxy")])


def locations_table(land: DataFrame, marine: DataFrame, seas: DataFrame, country_groups: DataFrame, regions: DataFrame, names: DataFrame) -> DataFrame:
    """All locations: countries and groups with land and sea areas and bounds, and the seas.

    land: (code, geometry); marine: (code, AREA_KM2, has_shared_marine_area, geometry); seas: (MRGID, NAME,
    area, min_X, min_Y, max_X, max_Y); groups as (grp, member); names: (code, name, name_es, name_fr,
    name_pt). A marine area that isn't given is measured.
    """
    groups = country_groups.select("grp", "member", F.lit("country").alias("k")).unionByName(regions.select("grp", "member", F.lit("region").alias("k")))
    kinds = groups.select(F.col("grp").alias("code"), "k").distinct()
    sides = [with_group_rows(d, groups.select("grp", "member"), "group") for d in (land.select("code", "geometry"), marine.select("code", "AREA_KM2", "has_shared_marine_area", "geometry"))]
    on_land = sides[0].select("code", "groups", "members", whole(st_area_km2("geometry")).alias("total_terrestrial_area"), bounds_list().alias("terrestrial_bounds"))
    at_sea = sides[1].select(
        "code", F.col("groups").alias("_groups"), F.col("members").alias("_members"), "has_shared_marine_area",
        F.coalesce(number("AREA_KM2"), st_area_km2("geometry")).alias("total_marine_area"), bounds_list().alias("marine_bounds"),
    )
    rows = on_land.join(at_sea, "code", "full").join(kinds, "code", "left").join(names, "code", "left").select(
        "code", F.coalesce("k", F.lit("country")).alias("type"), "name", "name_es", "name_fr", "name_pt",
        F.coalesce("groups", "_groups").alias("groups"), F.coalesce("members", "_members").alias("members"),
        "total_terrestrial_area", "total_marine_area", "terrestrial_bounds", "marine_bounds", "has_shared_marine_area",
    )
    blank = {c: F.lit("") for c in ("name_es", "name_fr", "name_pt")}
    sea_rows = seas.select(
        F.col("MRGID").cast("string").alias("code"), F.lit("sea").alias("type"), F.col("NAME").alias("name"), number("area").alias("total_marine_area"),
        F.lit(0).cast("long").alias("total_terrestrial_area"), F.array(*[number(c) for c in ("min_X", "min_Y", "max_X", "max_Y")]).alias("marine_bounds"),
    ).withColumns(blank)
    out = rows.unionByName(sea_rows, allowMissingColumns=True)
    return out.withColumns({"has_shared_marine_area": F.coalesce("has_shared_marine_area", F.lit(False)), "total_marine_area": F.coalesce(whole("total_marine_area"), F.lit(0).cast("long"))})


def site_geometries(sites: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Sites with an area of their own, points as circles of it, valid shapes only, bounds, simplified."""
    rows = choose_area(sites)
    reserve = F.coalesce(F.col("DESIG_ENG") == "UNESCO-MAB Biosphere Reserve", F.lit(False)) if "DESIG_ENG" in sites.columns else F.lit(False)
    rows = rows.withColumn("geometry", F.when(reserve, F.col("geometry")).otherwise(st_buffer_km2("geometry", "calculated_area_km2")))
    rows = rows.withColumn("geometry", F.explode(st_repaired("geometry")))
    rows = rows.withColumn("bbox", bounds_list())
    return rows.withColumn("geometry", st_simplify("geometry", tolerance)) if tolerance else rows


def mangroves_by_location(mangroves: DataFrame, locations: DataFrame, areas: DataFrame, size: float = 1.0) -> DataFrame:
    """(location, total_mangrove_area_km2, protected_mangrove_area_km2): overlaps count once in both."""
    km2 = lambda shape, cell: st_area_km2(st_intersection(shape, cell))
    woods = united_cells(mangroves, size)
    guarded = united_cells(areas, size).withColumnRenamed("_u", "_v")
    both = woods.join(guarded, ["_i", "_j"]).select("_i", "_j", st_intersection("_u", "_v").alias("_u"))
    total = covered(locations, woods, ["location"], size, "total_mangrove_area_km2", km2)
    protected = covered(locations, both, ["location"], size, "protected_mangrove_area_km2", km2)
    return total.join(protected, "location", "left").na.fill(0.0, ["protected_mangrove_area_km2"])


def peaks_in(peaks: DataFrame, zones: DataFrame, size: float = 1.0) -> DataFrame:
    """(PEAKID, AREA2D, location) of peaks that touch zones."""
    return spatial_join(peaks, zones.select("location", "geometry"), "intersects", size).select("PEAKID", "AREA2D", "location")


def stitched(seas: DataFrame, parts: Sequence[str], row: dict[str, object], key: str = "NAME") -> DataFrame:
    """Seas with one more: the union of some of them, with given attributes."""
    some = seas.where(F.col(key).isin(list(parts)))
    one = some.agg(st_union_agg("geometry").alias("geometry")).withColumns({c: F.lit(v) for c, v in row.items()})
    return seas.unionByName(one, allowMissingColumns=True)


def region_tiles(zones: DataFrame, regions: DataFrame, names: DataFrame) -> DataFrame:
    """Shapes of regions with their names, for tiles: zones (location, geometry), regions (grp, member)."""
    joined = zones.join(regions, zones["location"] == regions["member"]).select(F.col("grp").alias("region_id"), "geometry")
    return dissolve(joined, ["region_id"]).join(names.withColumnRenamed("code", "region_id"), "region_id", "left")
