"""The register of named queries.

The driver's tables stand in for the domain's: nations are locations, regions are groups of them, line
items are protected areas (return flag = status, quantity = area, ship year = year of designation), orders
are records with snapshots, events are a change feed. Floating results are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows dealt over the cluster: a small file may hold many, and each costs geometry work."""
    return df.repartition(key)


def r6(c):
    """Six decimals; adding 0 takes away the sign of a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def country_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, group, total_area, protected_area, n): line items summed by supplier before the joins, so
    what is joined is a row for each supplier."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    by_supplier = l.groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("q"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("p"), F.count("*").alias("n")
    )
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = by_supplier.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("q").alias("total_area"), F.sum("p").alias("protected_area"), F.sum("n").alias("n"))
    return joined.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("location"), F.col("r_name").alias("grp"), "total_area", "protected_area", F.col("n").cast("long").alias("n")
    )


#: The same in SQL, as a CTE body.
COUNTRY_SQL = """
SELECT n_name AS location, r_name AS grp, SUM(l_quantity) AS total_area,
       SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS protected_area, COUNT(*) AS n
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name
"""


def region_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("grp"), F.col("n_name").alias("member"))


#: (spark, sf_dir) -> rows, registered by the modules that follow.
from reefline.plans import cleaning, geometry, locations, rasters, reading, requests, rollups, sites, snapshots, spatial  # noqa: E402, F401
