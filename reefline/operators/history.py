"""Operators over years and ranks: latest records, running unions, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_last_year(df: DataFrame, keys: Sequence[str] = ("location", "environment"), year: str = "year") -> DataFrame:
    return df.withColumn("is_last_year", F.col(year) == F.max(year).over(Window.partitionBy(*keys)))


def latest_per(df: DataFrame, key: Sequence[str], by: str, ties: Sequence[str] = ()) -> DataFrame:
    """The last row of each key by a column (then by ``ties``)."""
    order = [F.col(by).desc_nulls_last(), *[F.col(t).asc() for t in ties]]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def fullest_years(df: DataFrame, locations: str = "locations") -> DataFrame:
    """Years that have as many locations as any year. ``df`` has a row for each year."""
    most = df.agg(F.max(F.size(locations)).alias("_most"))
    return df.crossJoin(F.broadcast(most)).where(F.size(locations) == F.col("_most")).drop("_most")  # one row


def running_union(df: DataFrame, keys: Sequence[str], item: str, year: str, years: DataFrame) -> DataFrame:
    """(keys, year, n): distinct items of each key up to each year of ``years`` (a column ``year``).

    Only the first year of an item matters, so items aren't copied to later years: first appearances are
    counted by year and summed along the years.
    """
    first = df.groupBy(*keys, item).agg(F.min(year).alias("_first"))
    counts = first.groupBy(*keys, F.col("_first").alias("year")).agg(F.count("*").alias("_new"))
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(years.select("year").distinct()))  # years: a few dozen rows
    marks = counts.unionByName(grid.withColumn("_new", F.lit(0).cast("long"))).groupBy(*keys, "year").agg(F.sum("_new").alias("_new"))
    window = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumn("n", F.sum("_new").over(window)).drop("_new").join(F.broadcast(years.select("year").distinct()), "year", "left_semi").select(*keys, "year", "n")


def next_or_zero(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.lead(value, 1, 0).over(Window.partitionBy(*keys).orderBy(*order))


def mark_children(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """is_child on all but the first row of a key, n_children on the first one."""
    w = Window.partitionBy(key).orderBy(*order)
    n = F.row_number().over(w)
    rows = F.count("*").over(Window.partitionBy(key)).cast("int")
    return df.withColumns({"is_child": n > 1, "n_children": F.when(n == 1, rows - 1).otherwise(0)})


def projection(history: DataFrame, target: int = 2030, last: int = 20) -> DataFrame:
    """(year, percentage, historical, projected, active): a straight line from the first to the last year
    with data and on to the target year, 100 at most; the last ``last`` years of all.

    The line starts at the first of the years that are shown. ``history`` has a row for each year.
    """
    ends = history.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    years = ends.select(F.explode(F.sequence("lo", F.greatest("hi", F.lit(target)))).alias("year"))
    future = years.join(history.agg(F.max("year").alias("hi"))).where("year > hi").select("year")
    shown = history.select("year", "percentage").unionByName(future.withColumn("percentage", F.lit(None).cast("double")))
    shown = shown.orderBy(F.col("year").desc()).limit(last)
    marks = shown.where("percentage is not null").agg(
        F.min("year").alias("y0"), F.min_by("percentage", "year").alias("p0"), F.max("year").alias("y1"), F.max_by("percentage", "year").alias("p1")
    )
    slope = F.try_divide(F.col("p1") - F.col("p0"), (F.col("y1") - F.col("y0")).cast("double"))
    line = shown.crossJoin(F.broadcast(marks))  # one row
    return line.select(
        "year",
        "percentage",
        F.when(F.col("year") <= F.col("y1"), F.col("p0") + slope * (F.col("year") - F.col("y0"))).alias("historical"),
        F.when(F.col("year") >= F.col("y1"), F.least(F.lit(100.0), F.col("p1") + slope * (F.col("year") - F.col("y1")))).alias("projected"),
        (F.col("year") == F.col("y1")).alias("active"),
    )
