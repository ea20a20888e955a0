"""A grid that adapts: the leaves of a quadtree, split where shapes crowd.

The tree is made on the driver from a bounded sample of boxes' centres, whose counts are scaled up; it has a
bounded number of leaves, so it is a small value that tasks carry. Shapes go to the leaves their boxes meet:
many small ones where shapes crowd, few large ones elsewhere, so a shape over all of the world has no more
copies than there are leaves. The sample decides how even the work is, never which pairs are found.

What was dealt out is joined by sorting (hint merge): Spark takes a table for as small as its compressed file,
however many leaves its rows go to, and would gather it on the driver to broadcast it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.geo.functions import PREDICATES, st_area, st_bounds, st_box, st_difference, st_intersection, st_solid, st_union_agg

#: Rows sampled, leaves and depth at most.
SAMPLE = 1 << 16
LEAVES = 4096
DEPTH = 16


@dataclass(frozen=True)
class Quadtree:
    """Nodes as arrays: corner and width, and the first of four children (0: a leaf)."""

    x: np.ndarray
    y: np.ndarray
    width: np.ndarray
    height: np.ndarray
    child: np.ndarray

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray, world: tuple[float, float, float, float], most: float, leaves: int = LEAVES, depth: int = DEPTH) -> Quadtree:
        """Splits the fullest leaf until none holds more than ``most`` of the points or ``leaves`` are reached."""
        import heapq

        nodes = [(world[0], world[1], world[2] - world[0], world[3] - world[1], 0)]
        child = [0]
        heap = [(-len(x), 0, np.arange(len(x)))]
        count = 1
        while heap and -heap[0][0] > most and count + 3 <= leaves:
            _, at, own = heapq.heappop(heap)
            x0, y0, w, h, level = nodes[at]
            right, upper = x[own] >= x0 + w / 2, y[own] >= y0 + h / 2
            child[at] = len(nodes)
            count += 3
            for k in range(4):
                part = own[(right == (k % 2 == 1)) & (upper == (k >= 2))]
                nodes.append((x0 + w / 2 * (k % 2), y0 + h / 2 * (k // 2), w / 2, h / 2, level + 1))
                child.append(0)
                if level + 1 < depth:
                    heapq.heappush(heap, (-len(part), len(nodes) - 1, part))
        at = np.array([n[:4] for n in nodes])
        return Quadtree(at[:, 0], at[:, 1], at[:, 2], at[:, 3], np.array(child))

    def met(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that each of n x 4 boxes meets, borders included."""
        row, node, rows, leaves = np.arange(len(boxes)), np.zeros(len(boxes), dtype=np.int64), [], []
        while len(row):
            end = self.child[node] == 0
            rows.append(row[end])
            leaves.append(node[end])
            row, node = np.repeat(row[~end], 4), (self.child[node[~end]][:, None] + np.arange(4)).ravel()
            b = boxes[row]
            meets = (b[:, 0] <= self.x[node] + self.width[node]) & (b[:, 2] >= self.x[node]) & (b[:, 1] <= self.y[node] + self.height[node]) & (b[:, 3] >= self.y[node])
            row, node = row[meets], node[meets]
        return np.concatenate(rows), np.concatenate(leaves)


def _bounded(df: DataFrame) -> DataFrame:
    return df.select("_b.*").where("minx is not null")


def quadtree(boxes: DataFrame, capacity: int = 20_000, *, leaves: int = LEAVES, depth: int = DEPTH) -> Quadtree:
    """The tree of a table of boxes (minx, miny, maxx, maxy) with about ``capacity`` of them by leaf."""
    size = boxes.agg(F.count("*").alias("n"), *[f(c).alias(c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))]).first()
    if not size.n:
        return Quadtree.of(np.zeros(0), np.zeros(0), (0.0, 0.0, 1.0, 1.0), 1)
    share = min(1.0, SAMPLE / size.n)
    centres = boxes.select(((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    drawn = (centres if share == 1 else centres.sample(share, seed=7)).limit(2 * SAMPLE).toPandas()
    # A little wider than the boxes, so that no border of the world is the border of a shape.
    dx, dy = (max(hi - lo, 1e-9) * 1e-3 for lo, hi in ((size.minx, size.maxx), (size.miny, size.maxy)))
    world = (size.minx - dx, size.miny - dy, size.maxx + dx, size.maxy + dy)
    return Quadtree.of(drawn.x.to_numpy(), drawn.y.to_numpy(), world, max(1.0, capacity * share), leaves, depth)


def leaves_of(tree: Quadtree, bounds: str = "_b") -> Column:
    """Array of (leaf, x0, y0, x1, y1): the leaves that a struct of bounds meets, with their corners."""

    @F.pandas_udf("array<struct<leaf:long,x0:double,y0:double,x1:double,y1:double>>")
    def run(b: pd.DataFrame) -> pd.Series:
        boxes = b[["minx", "miny", "maxx", "maxy"]].to_numpy(dtype=np.float64, na_value=np.nan)
        row, leaf = tree.met(boxes)
        out: list[list[dict]] = [[] for _ in range(len(b))]
        corners = np.column_stack([tree.x, tree.y, tree.x + tree.width, tree.y + tree.height])
        for r, k in zip(row.tolist(), leaf.tolist(), strict=True):
            x0, y0, x1, y1 = corners[k].tolist()
            out[r].append({"leaf": k, "x0": x0, "y0": y0, "x1": x1, "y1": y1})
        return pd.Series(out)

    return run(bounds)


def dealt(df: DataFrame, tree: Quadtree, bounds: str = "_b") -> DataFrame:
    """A row for each leaf that the row's bounds meet, as a struct ``_leaf``."""
    return df.withColumn("_leaf", F.explode(leaves_of(tree, bounds)))


def box_pairs(left: DataFrame, right: DataFrame, tree: Quadtree) -> DataFrame:
    """(a, b): pairs of rows (id, _b) whose bounds touch. A pair is tested in one leaf only, that of the
    lower left corner of the overlap, which is the same on both sides."""
    a = dealt(left, tree).select(F.col("id").alias("a"), F.col("_b").alias("_ba"), "_leaf.*")
    b = dealt(right, tree).select(F.col("id").alias("b"), F.col("_b").alias("_bb"), F.col("_leaf.leaf").alias("leaf"))
    x, y = F.greatest("_ba.minx", "_bb.minx"), F.greatest("_ba.miny", "_bb.miny")
    touch = (x <= F.least("_ba.maxx", "_bb.maxx")) & (y <= F.least("_ba.maxy", "_bb.maxy"))
    once = (x >= F.col("x0")) & (x < F.col("x1")) & (y >= F.col("y0")) & (y < F.col("y1"))
    return a.join(b.hint("merge"), "leaf").where(touch & once).select("a", "b")


def tree_of(left: DataFrame, right: DataFrame, capacity: int) -> Quadtree:
    """The tree of both sides' boxes (tables with a struct ``_b``)."""
    return quadtree(_bounded(left).unionByName(_bounded(right)), capacity)


def adaptive_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, predicate: str = "intersects", capacity: int = 20_000) -> DataFrame:
    """Pairs of rows whose geometries meet the predicate; ``left_id`` and ``right_id`` tell rows apart.

    Only ids and boxes are dealt out and joined; shapes are attached to the pairs whose boxes touch, so a
    large shape is sent once for each of its partners and never once for each cell. Columns of the right
    side that the left has too get a suffix _r. Null and empty geometries have no partners.
    """
    a = left.select(F.col(left_id).alias("id"), st_bounds("geometry").alias("_b")).where("_b.minx is not null")
    b = right.select(F.col(right_id).alias("id"), st_bounds("geometry").alias("_b")).where("_b.minx is not null")
    pairs = box_pairs(a, b, tree_of(a, b, capacity))
    renamed = right.select(*[F.col(c).alias(f"{c}_r" if c in left.columns else c) for c in right.columns])
    right_name = f"{right_id}_r" if right_id in left.columns else right_id
    with_left = left.join(pairs.hint("merge"), F.col(left_id) == F.col("a")).drop("a")
    both = with_left.join(renamed.hint("merge"), F.col(right_name) == F.col("b")).drop("b")
    return both.where(PREDICATES[predicate]("geometry", "geometry_r" if "geometry" in left.columns else "geometry"))


def first_cover(shapes: DataFrame, keys: Sequence[str], year: str = "year", geometry: str = "geometry", tree: Quadtree | None = None, capacity: int = 5_000) -> DataFrame:
    """(keys, year, geometry): pieces of ground with the first year in which a shape of the key covers them;
    pieces of a key don't overlap.

    Equal shapes of a key count from the earliest year. Shapes are cut to leaves; one sweep of a leaf gives each
    place the first year of those that cover it, however many years follow. Rows without a year or shape are left
    out.
    """
    rows = shapes.where(F.col(year).isNotNull() & F.col(geometry).isNotNull()).groupBy(*keys, F.col(geometry).alias("_g")).agg(F.min(year).alias("_year"))
    rows = rows.select(*keys, "_year", "_g", st_bounds("_g").alias("_b")).where("_b.minx is not null")
    tree = tree or quadtree(_bounded(rows), capacity)
    corner = [F.col(f"_leaf.{c}") for c in ("x0", "y0", "x1", "y1")]
    cut = dealt(rows, tree).select(*keys, "_year", F.col("_leaf.leaf").alias("_leaf"), F.explode(st_solid(st_intersection("_g", st_box(*corner)))).alias("_g"))
    first = cut.groupBy(*keys, "_leaf", "_g").agg(F.min("_year").alias("_year"))
    kinds = {f.name: f.dataType.simpleString() for f in first.schema}
    names = [*keys, "_year"]
    schema = ", ".join([*[f"`{n}` {kinds[n]}" for n in names], "_g binary"])

    def sweep(group: pd.DataFrame) -> pd.DataFrame:
        from reefline.geo import kernel as K
        from reefline.geo import slabs

        found = group.sort_values("_year").groupby("_year", sort=True)
        years = [[p for g in K.read(part["_g"].tolist()) for p in g] for _, part in found]
        _, label, t = slabs.trapezoids(*slabs.edges([years]), len(years), lambda within: np.where(within.any(1), within.argmax(1) + 1, 0))
        order = np.argsort(label, kind="stable")
        new = slabs.shapes(label[order] - 1, t[order], len(years))
        return found.head(1)[names].assign(_g=[K.to_wkb(g) for g in new])

    pieces = first.groupBy(*keys, "_leaf").applyInPandas(sweep, schema)
    return pieces.where(st_area("_g") > 0).select(*keys, F.col("_year").alias(year), F.col("_g").alias("geometry"))


def covered_by_year(shapes: DataFrame, keys: Sequence[str], years: DataFrame, year: str = "year", geometry: str = "geometry", tree: Quadtree | None = None, capacity: int = 5_000) -> DataFrame:
    """(keys, year, area): area of the union of each key's shapes up to each year of ``years`` (a column
    ``year``), from the first one with a shape of that key on: a running sum over the ground that is new."""
    new = first_cover(shapes, keys, year, geometry, tree, capacity).groupBy(*keys, F.col(year).alias("year")).agg(F.sum(st_area("geometry")).alias("area"))
    first = new.groupBy(*keys).agg(F.min("year").alias("_first"))
    wanted = years.select("year").distinct()
    grid = first.join(wanted, F.col("year") >= F.col("_first")).select(*keys, "year", F.lit(0.0).alias("area"), F.lit(True).alias("_asked"))
    marks = new.withColumn("_asked", F.lit(False)).unionByName(grid).groupBy(*keys, "year").agg(F.sum("area").alias("area"), F.max("_asked").alias("_asked"))
    upto = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumn("area", F.sum("area").over(upto)).where("_asked").drop("_asked")


def split_difference(left: DataFrame, right: DataFrame, key: str, capacity: int = 5_000) -> DataFrame:
    """(key, geometry): each left shape without the right ones, in pieces by leaf; only the cutters that lie
    in a leaf meet there, so no task holds all cutters of a large shape."""
    a, b = (d.select(F.col("geometry").alias("_g")).where("_g is not null").distinct().withColumn("_b", st_bounds("_g")).where("_b.minx is not null") for d in (left, right))
    tree = tree_of(a, b, capacity)
    corner = [F.col(f"_leaf.{c}") for c in ("x0", "y0", "x1", "y1")]

    def cut(df: DataFrame, *columns: str) -> DataFrame:
        return dealt(df, tree).select(*[F.col(c).alias("_shape") for c in columns], F.col("_leaf.leaf").alias("leaf"), F.explode(st_solid(st_intersection("_g", st_box(*corner)))).alias("_g"))

    cutters = cut(b).distinct().groupBy("leaf").agg(st_union_agg("_g").alias("_cut"))
    met = cut(a, "_g").join(cutters.hint("merge"), "leaf", "left")
    rest = met.select("_shape", F.explode(st_solid(F.when(F.col("_cut").isNull(), F.col("_g")).otherwise(st_difference("_g", F.coalesce("_cut", "_g"))))).alias("_rest"))
    return left.select(key, "geometry").join(rest.hint("merge"), F.col("geometry") == F.col("_shape")).select(key, F.col("_rest").alias("geometry"))
