"""Cleaning and derived columns of protected-area, fishing and habitat rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.functions.numbers import blank_to_null, number, percent, present, row_sum
from reefline.functions.text import float_list, lookup, python_dict, year_of

# Codes and labels of the source tables.
ENVIRONMENT = {0: "terrestrial", 1: "marine", 2: "marine"}
STATUS = {0: "oecm", 1: "pa"}
SITE_TYPE = {"OECM": 0, "PA": 1}
REALM = {"Terrestrial": "0", "Marine": "1", "Coastal": "2"}
STAGE = {
    "actively managed": "actively-managed",
    "designated": "designated",
    "implemented": "implemented",
    "unknown": "unknown",
    "proposed/committed": "proposed-committed",
}
HABITATS = {
    "coldwatercorals": "cold-water corals",
    "saltmarshes": "saltmarshes",
    "warmwatercorals": "warm-water corals",
    "seagrasses": "seagrasses",
    "mangroves": "mangroves",
    "seamounts": "seamounts",
    "climate-resilient-corals": "climate-resilient-corals",
    "other-corals": "other-corals",
    "Artificial": "artificial",
    "Forest": "forest",
    "Grassland": "grassland",
    "Wetlands/open water": "wetlands-open-waters",
    "Desert": "desert",
    "Rocky/mountains": "rocky-mountains",
    "Savanna": "savanna",
    "Shrubland": "shrubland",
}


def old_names(df: DataFrame) -> DataFrame:
    """Current site columns under their earlier names, with numeric definition and realm codes."""
    renamed = {"SITE_ID": "WDPAID", "SITE_PID": "WDPA_PID", "NAME_ENG": "NAME", "NAME": "ORIG_NAME", "PRNT_ISO3": "PARENT_ISO3"}
    kept = [F.col(c).alias(renamed.get(c, c)) for c in df.columns if c not in ("SITE_TYPE", "REALM")]
    return df.select(*kept, lookup("SITE_TYPE", SITE_TYPE).alias("PA_DEF"), lookup("REALM", REALM).alias("MARINE"))


def add_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in values.items()})


def add_environment(df: DataFrame, source: str = "MARINE") -> DataFrame:
    return df.withColumn("environment", lookup(F.col(source).cast("string").try_cast("int"), ENVIRONMENT))


def add_status(df: DataFrame, source: str = "PA_DEF") -> DataFrame:
    """pa or oecm; an unknown code is an error."""
    code = F.col(source).cast("string").try_cast("int")
    wrong = F.raise_error(F.concat(F.lit(f"unknown {source}: "), F.coalesce(F.col(source).cast("string"), F.lit("null"))))
    return df.withColumn("protection_status", F.when(code == 0, STATUS[0]).when(code == 1, STATUS[1]).otherwise(wrong.cast("string")))


def add_coverage(df: DataFrame, marine: DataFrame, land: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with coverage, rejected rows): percent of the location's area of the environment, 100 at most.

    ``marine`` and ``land`` hold (location, AREA_KM2). At sea ATA takes the area of ABNJ and HKG that of CHN.
    """
    patched = F.when(F.col("location") == "ATA", "ABNJ").when(F.col("location") == "HKG", "CHN").otherwise(F.col("location"))
    area = lambda t, name: t.groupBy(F.col("location").alias("_loc")).agg(F.max(number("AREA_KM2")).alias(name))
    joined = (
        df.withColumn("_sea", patched)
        .join(area(marine, "_marine").withColumnRenamed("_loc", "_sea"), "_sea", "left")
        .join(area(land, "_land").withColumnRenamed("_loc", "location"), "location", "left")
    )
    whole = F.when(F.col("environment") == "marine", F.col("_marine")).when(F.col("environment") == "terrestrial", F.col("_land"))
    covered = F.least(F.lit(100.0), percent(present("area"), whole))
    # least() skips a null, so the null has to be kept by hand
    value = F.when(percent(present("area"), whole).isNotNull(), covered)
    out = joined.select(*df.columns, value.alias("coverage"))
    return out.where("coverage is not null"), out.where("coverage is null")


def add_level_areas(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    return df.withColumns({f"{level}_protected_area": row_sum(columns) for level, columns in levels.items()})


def add_level_percents(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{level}_pct": percent(f"{level}_protected_area", "total_area") for level in levels})


def add_parent(df: DataFrame, parents: DataFrame, source: str = "location") -> DataFrame:
    """``parents`` holds (code, parent_id), each code once; a location without one is its own parent."""
    return df.join(parents.withColumnRenamed("code", source), source, "left").withColumn("parent_id", F.coalesce("parent_id", source)).select(*df.columns, "parent_id")


def add_shares(df: DataFrame) -> DataFrame:
    """Shares and counts of protected areas and other measures."""
    share = F.try_divide(F.col("pa_coverage"), F.col("coverage"))
    return df.withColumns(
        {
            "pas_percent_area": 100 * share,
            "oecm_percent_area": 100 * (1 - share),
            "pas_count": F.col("protected_area_polygon_count") + F.col("protected_area_point_count"),
            "oecm_count": F.col("oecm_polygon_count") + F.col("oecm_point_count"),
        }
    )


def add_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("percentage", F.try_divide("protected_area", "area"))


def add_total_from_percent(df: DataFrame) -> DataFrame:
    """The total a percentage implies; where that is 0, the reported area."""
    implied = F.try_divide(F.col("protected_area"), F.col("percentage") / 100.0)
    return df.withColumn("total_area", F.when(F.col("percentage") == 0, F.col("wdpa_marine_km2")).otherwise(implied))


def add_year(df: DataFrame, source: str = "designated_date") -> DataFrame:
    return df.withColumn("year", year_of(source))


def stage_slugs(df: DataFrame, source: str = "mpaa_establishment_stage") -> DataFrame:
    return df.withColumn(source, lookup(source, STAGE))


def choose_area(df: DataFrame) -> DataFrame:
    """The mapped area if positive, else the reported one if positive, else 0."""
    positive = lambda c: F.when(number(c) > 0, number(c))
    sources = [c for c in ("GIS_AREA", "REP_AREA") if c in df.columns]
    return df.withColumn("calculated_area_km2", F.coalesce(*[positive(c) for c in sources], F.lit(0.0)))


def convert(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Casts columns: "int", "float", "list_of_floats" or "str"; what doesn't fit becomes null."""
    casts = {"int": lambda c: number(c).cast("long"), "float": number, "list_of_floats": float_list, "str": lambda c: F.col(c).cast("string")}
    return df.withColumns({c: casts[k](c) for c, k in kinds.items()})


def expand_dict(df: DataFrame, source: str, names: Mapping[str, str], kind: str = "double") -> DataFrame:
    """Columns from keys of a dict literal: source key -> column."""
    schema = "struct<" + ", ".join(f"`{k}`: {kind}" for k in names) + ">"
    parsed = df.withColumn("_dict", python_dict(source, schema))
    return parsed.withColumns({v: F.col(f"_dict.`{k}`") for k, v in names.items()}).drop("_dict")


def resolve_territories(df: DataFrame) -> DataFrame:
    """The location of each row: a sovereign with one row and no territory stands for itself; otherwise
    rows without territory go, and the territory NAT means the sovereign's own."""
    territory = F.coalesce("iso_ter", F.lit(""))
    alone = F.count("*").over(Window.partitionBy("iso_sov")) == 1
    where = F.when(alone & (territory == ""), F.col("iso_sov")).when(territory == "NAT", F.col("iso_sov")).when(territory != "", territory)
    return df.where("iso_sov is not null").withColumn("location", where).where("location is not null").drop("iso_ter")


def mask_level(df: DataFrame) -> DataFrame:
    active = F.coalesce(F.col("establishment_stage").isin("actively managed", "implemented"), F.lit(False))
    return df.withColumn("protection_mpaguide_level", F.when(active, F.col("protection_mpaguide_level")).otherwise("unknown"))


def relabel(df: DataFrame, changes: Mapping[str, str] | None = None, source: str = "location") -> DataFrame:
    """Other codes for some locations; rows that become equal are one."""
    changes = {"ATA": "ABNJ", "ALA": "FIN"} if changes is None else changes
    return df.withColumn(source, lookup(source, changes, F.col(source))).dropDuplicates()


def known_habitats(df: DataFrame) -> DataFrame:
    return df.withColumn("habitat", lookup("habitat", HABITATS)).where("habitat is not null")


def starred(df: DataFrame, *, apply: bool = False, source: str = "location") -> DataFrame:
    """Rows with a plain code. With ``apply``, a starred row's protected area replaces that of the plain
    code (the largest, where several are)."""
    plain = df.where(~F.contains(F.col(source), F.lit("*")))
    if not apply:
        return plain
    stars = df.where(F.contains(F.col(source), F.lit("*"))).groupBy(F.replace(F.col(source), F.lit("*"), F.lit("")).alias(source)).agg(F.max("protected_area").alias("_star"))
    return plain.join(stars, source, "left").withColumn("protected_area", F.coalesce("_star", "protected_area")).select(*df.columns)


def rounded_bounds(bounds: Sequence[Column | str]) -> Column:
    return F.array(*[F.bround(F.col(b) if isinstance(b, str) else b, 5) for b in bounds])


def claimants(territories: Sequence[str], sovereigns: Sequence[str], rollups: Sequence[str]) -> Column:
    """Parents of a zone from pairs of territory and sovereign codes: the territory, else the sovereign,
    and the sovereigns' roll-ups (code with a star) that exist; each once, sorted."""
    own = [F.coalesce(blank_to_null(t), blank_to_null(s)) for t, s in zip(territories, sovereigns, strict=True)]
    stars = [F.when(F.concat(F.col(s), F.lit("*")).isin(list(rollups)), F.concat(F.col(s), F.lit("*"))) for s in sovereigns]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*own, *stars))))


def positions(source: str, names: Sequence[str]) -> list[Column]:
    return [F.get(F.col(source), i).alias(n) for i, n in enumerate(names)]


def designated(df: DataFrame) -> DataFrame:
    return df.where(F.col("STATUS") == "Designated") if "STATUS" in df.columns else df.where("designated_date is not null")


def without_reserves(df: DataFrame) -> DataFrame:
    """Drops biosphere reserves unless they are other effective measures."""
    reserve = F.coalesce(F.col("DESIG_ENG") == "UNESCO-MAB Biosphere Reserve", F.lit(False))
    return df.where(~reserve | F.coalesce(F.col("PA_DEF").cast("int") == 0, F.lit(False)))


def split_realms(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(land, sea) by the MARINE code."""
    code = F.col("MARINE").cast("string").try_cast("int")
    return df.where(code == 0), df.where(code.isin(1, 2))


def merge_codes(df: DataFrame, merges: Mapping[str, Sequence[str]], source: str = "location") -> DataFrame:
    """Rows of several codes as one row with the sums of their numbers; text columns keep the first value.
    Only rows of merged codes are aggregated."""
    to = {c: target for target, codes in merges.items() for c in codes}
    hit = F.coalesce(F.col(source).isin(list(to)), F.lit(False))
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "long") and c != source]
    others = [c for c in df.columns if c not in numeric and c != source]
    merged = df.where(hit).groupBy(lookup(source, to).alias(source)).agg(*[F.sum(c).alias(c) for c in numeric], *[F.first(c, ignorenulls=True).alias(c) for c in others])
    return df.where(~hit).unionByName(merged.select(*df.columns), allowMissingColumns=True)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break rules, with the names of those in ``errors``. A rule that is null holds."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("errors", errors).where(F.size("errors") > 0)
