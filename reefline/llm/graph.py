"""Connected components over edge tables, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import kept, workspace, written

#: Edges for each partition of a round's tables.
ROWS = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node it is joined with.

    Each round hooks every node to its smallest neighbour, shortens the chains of hooks twice, and
    contracts the edges; the edges left shrink at least by halves on chains and vanish at once on stars.
    Minima are combined before their shuffle. What is joined is always a written table on both sides, so
    adaptive execution can split a node that most edges share. Loops are ignored; no edges, no nodes.
    """
    spark = edges.sparkSession
    with workspace(spark, "components"):
        two_way = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
        left = written(two_way.unionByName(two_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        labels = None
        while n := left.count():
            parts = 1 + n // ROWS  # few rows need few files

            def put(df: DataFrame, name: str, parts: int = parts) -> DataFrame:
                return written(df.coalesce(parts), name)

            hook = put(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "hooks")
            for _ in range(2):
                step = hook.select(F.col("node").alias("to"), F.col("to").alias("_next"))
                hook = put(hook.join(step, "to", "left").select("node", F.coalesce("_next", "to").alias("to")), "hooks")
            if labels is None:
                labels = hook.withColumnRenamed("to", "component")
            else:
                step = hook.select(F.col("node").alias("component"), F.col("to").alias("_next"))
                labels = written(labels.join(step, "component", "left").select("node", F.coalesce("_next", "component").alias("component")), "labels")
            to_a, to_b = hook.select(F.col("node").alias("a"), F.col("to").alias("_a")), hook.select(F.col("node").alias("b"), F.col("to").alias("_b"))
            left = put(left.join(to_a, "a").join(to_b, "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "edges")
        if labels is None:
            labels = left.select(F.col("a").alias("node"), F.col("b").alias("component"))
        return kept(labels, "components")
