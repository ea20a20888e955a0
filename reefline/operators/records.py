"""Site records of earlier pipelines: small rules on columns, stacked sources, final formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.functions.text import lookup, split_codes
from reefline.operators.groups import rollup, total
from reefline.sources.scratch import scratch_table


def reported(df: DataFrame) -> DataFrame:
    """Reported sites that are no biosphere reserves."""
    reserve = F.coalesce(F.contains(F.upper("DESIG_ENG"), F.lit("MAB")), F.lit(False))
    return df.where((F.col("STATUS") != "Not Reported") & ~reserve)


def not_proposed(df: DataFrame) -> DataFrame:
    return df.where(F.col("STATUS") != "Proposed")


def site_id(part: str = "wdpa_pid", whole: str = "wdpa_id") -> Column:
    """The part's id if it has one (the text None is none), else the site's."""
    return F.coalesce(F.nullif(part, F.lit("None")), F.col(whole).cast("string"))


def level_label(level: str = "protection_mpaguide_level") -> Column:
    return F.when(F.col(level).isin("full", "high"), "fully or highly protected").otherwise("less protected or unknown")


def latest_year(*dates: str) -> Column:
    """The latest year of date texts; null if none has one."""
    years = [F.substring(d, 1, 4).try_cast("int") for d in dates]
    return F.nullif(F.greatest(*[F.coalesce(y, F.lit(0)) for y in years]), F.lit(0))


def fishing_class(score: str = "removal_of_marine_life_is_prohibited") -> Column:
    """Highly from 4 on, moderately at 3, less from 1 on."""
    s = F.col(score).try_cast("int")
    return F.when(s >= 4, "highly").when(s == 3, "moderately").when(s >= 1, "less")


def joined_codes(*columns: str) -> Column:
    """Present codes joined by ``;``."""
    return F.concat_ws(";", *[F.nullif(c, F.lit("")) for c in columns])


def number_in(text: str, pattern: str = r"(\d+)") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def backfilled(*columns: str) -> Column:
    """The first present of several columns."""
    return F.coalesce(*[F.col(c) for c in columns])


def replaced(df: DataFrame, changes: Mapping[str, str], column: str) -> DataFrame:
    return df.withColumn(column, lookup(column, changes, F.col(column)))


def one_row_per_code(df: DataFrame, column: str, separators: str = "[;:,]") -> DataFrame:
    return df.withColumn(column, F.explode(split_codes(column, separators)))


def stacked(*parts: DataFrame) -> DataFrame:
    """Union of sources by name; columns that a source lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def formatted(df: DataFrame, codes: DataFrame, values: Mapping[str, Mapping[str, str]], names: Mapping[str, str], drop: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Location ids joined, values mapped, columns renamed and dropped, and an id counted in a stated order.

    codes: (iso, location_id). The id is a rank over the whole table; it is computed by ranges, not in one
    task: rows before a range are added to the rank within it.
    """
    out = df.join(codes.withColumnRenamed("iso", "location"), "location", "left")
    for c, m in values.items():
        out = replaced(out, m, c)
    # Written once: read twice from a plan, adaptive execution could merge the ranges in two ways.
    ranged = scratch_table(out.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    numbered = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(before), "_part")
    numbered = numbered.withColumn("id", F.col("_rank") + F.col("_before"))
    return numbered.select("id", *[F.col(c).alias(names.get(c, c)) for c in out.columns if c not in drop])


def fishing_sources(df: DataFrame) -> DataFrame:
    """Sovereign rows flagged as multi-jurisdictional, and unflagged ones of sovereigns without such a row."""
    flagged = df.where("multi_jurisdictional")
    return flagged.unionByName(df.where("not coalesce(multi_jurisdictional, false)").join(flagged.select("iso_sov").distinct(), "iso_sov", "left_anti").select(*df.columns))


def fishing_totals(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Area and percentage by location and level, with region and global rows."""
    per = df.groupBy("location", "level").agg(F.sum("area").alias("area"), F.max("total_area").alias("total_area"))
    sums = [F.sum("area").alias("area"), F.sum("total_area").alias("total_area")]
    rows = per.unionByName(rollup(per, regions, "location", sums, by=["level"])).unionByName(total(per, "GLOB", sums, by=["level"]))
    return rows.withColumn("pct", F.bround(100 * F.try_divide("area", "total_area"), 2))


def sovereign_of(zones: DataFrame, territory: str, sovereign: str, order: str) -> DataFrame:
    """(code, parent_id): each territory's sovereign, that of its last row."""
    return zones.where(F.col(territory).isNotNull()).groupBy(F.col(territory).alias("code")).agg(F.max_by(sovereign, order).alias("parent_id"))


def unambiguous(df: DataFrame, code: str, parent: str) -> DataFrame:
    """Pairs of single codes (no ``;``), each once."""
    single = ~F.contains(F.coalesce(F.col(code), F.lit(";")), F.lit(";")) & ~F.contains(F.coalesce(F.col(parent), F.lit(";")), F.lit(";"))
    return df.where(single).select(code, parent).distinct()


def booleans(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``t`` and ``f`` as booleans; equal rows are one."""
    return df.withColumns({c: F.when(F.col(c) == "t", True).when(F.col(c) == "f", False) for c in columns}).dropDuplicates()
