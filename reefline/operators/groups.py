"""Roll-ups of rows to groups of members: the operator most tables are built from.

A group map becomes a bridge table (grp, member); a roll-up joins it to the rows and aggregates. Groups may
overlap: a row counts once in each group that has its member. The bridge is usually small; the optimiser
decides whether to broadcast it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bridge(spark: SparkSession, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(grp, member), each pair once. A group without members has one row whose member is null."""
    rows = [(g, m) for g, members in groups.items() for m in (dict.fromkeys(members) or [None])]
    return spark.createDataFrame(rows, "grp string, member string")


def bridge_of(df: DataFrame, map_col: str) -> DataFrame:
    """The bridge of a map<string, array<string>> column."""
    pairs = df.select(F.explode(F.map_entries(map_col)).alias("e"))
    return pairs.select(F.col("e.key").alias("grp"), F.explode_outer("e.value").alias("member")).distinct()


def rollup(
    rows: DataFrame,
    groups: DataFrame,
    member_col: str,
    aggregates: Sequence[Column],
    *,
    by: Sequence[str] = (),
    keep_empty: bool = False,
    name: str = "location",
) -> DataFrame:
    """Aggregates of the rows of each group (and of each value of ``by`` within it).

    Without ``keep_empty`` groups without a row are absent. With it they have a row of the aggregates over
    nothing, for each combination of ``by`` that occurs anywhere.
    """
    link = F.col("_g.member") == F.col(f"_r.{member_col}")
    if not keep_empty:
        joined = rows.alias("_r").join(groups.where("member is not null").alias("_g"), link)
        return joined.groupBy(F.col("_g.grp").alias(name), *[F.col(f"_r.{c}") for c in by]).agg(*aggregates)
    wanted = groups.select("grp", "member")
    on = link
    if by:
        kinds = rows.select(*by).distinct()
        wanted = wanted.join(kinds.select(*[F.col(c).alias(f"_by_{c}") for c in by]))  # a few kinds for each group
        for c in by:
            on = on & F.col(f"_g._by_{c}").eqNullSafe(F.col(f"_r.{c}"))
    joined = wanted.alias("_g").join(rows.alias("_r"), on, "left")
    return joined.groupBy(F.col("_g.grp").alias(name), *[F.col(f"_g._by_{c}").alias(c) for c in by]).agg(*aggregates)


def total(rows: DataFrame, label: str, aggregates: Sequence[Column], *, by: Sequence[str] = (), name: str = "location") -> DataFrame:
    """The same aggregates over all rows, labelled ``label``."""
    return rows.groupBy(*by).agg(*aggregates).select(F.lit(label).alias(name), "*")


def membership(groups: DataFrame) -> DataFrame:
    """(member, groups array): the groups of each member, sorted."""
    return groups.where("member is not null").groupBy("member").agg(F.array_sort(F.collect_set("grp")).alias("groups"))


def members(groups: DataFrame) -> DataFrame:
    """(grp, members array), empty for a group without any."""
    return groups.groupBy("grp").agg(F.array_sort(F.collect_set("member")).alias("members"))
