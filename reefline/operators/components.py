"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.sources.scratch import scratch_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); component is the smallest node within reach.

    Large and small stars by turns: each node is tied to the smallest node of its neighbourhood, first with
    its larger neighbours and then with its smaller ones, until nothing changes. A round is two joins on
    tables as large as the edges; there are about as many as the logarithm of the longest path.
    """
    now = scratch_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = scratch_table(both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        then = scratch_table(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), "stars")
        if then.exceptAll(now).isEmpty() and now.exceptAll(then).isEmpty():
            break
        now = then
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
