"""Dissolving without a task that holds a key.

Shapes are united within the leaves of a quadtree. What is left of a key are pieces that touch along leaf
borders and along the lines that the leaves' unions are made of. Their directed edges on an upright or level
line are swept, others meet end to end: where a piece lies on both sides the two edges cancel, and the pieces
are neighbours. The edges left
are the boundary, and contraction of neighbours says which of them belong to one connected part; a part's
rings are chained in one task, which sees that part's boundary and nothing of what lies inside.

Coordinates are whole numbers of a step (the world in 2^45), so edges of different leaves meet exactly. Sums
of closed rings are closed, so the edges left are too, whatever was rounded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reefline.geo.functions import st_bounds
from reefline.geo.quadtree import Quadtree, dealt, quadtree
from reefline.operators.components import components
from reefline.sources.scratch import scratch_table

STEPS = 1 << 45
#: A line is swept in so many stretches.
BANDS = 64


def _step(tree: Quadtree) -> tuple[float, float, float]:
    """Origin and step of the whole numbers."""
    size = max(float(tree.width[0]), float(tree.height[0]))
    return float(tree.x[0]), float(tree.y[0]), 2.0 ** np.ceil(np.log2(size)) / STEPS


def _pieces(names: Sequence[str], origin: tuple[float, float, float]):
    """The union of a leaf's shapes within the leaf as pieces, each with its directed edges (inside on the left)."""

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        from reefline.geo import kernel as K

        first, out = group.iloc[0], []
        shapes = [p for w in group["_g"] for p in K.polygons(K.from_wkb(w))]
        box = K.box(first.x0, first.y0, first.x1, first.y1)
        for polygon in K.shape(K.trapezoids([shapes, box], lambda w: w[:, 0] & w[:, 1])):
            edges: list[dict] = []
            for ring in polygon:
                at = np.rint((ring[:, :2] - origin[:2]) / origin[2]).astype(np.int64)
                at = at[np.concatenate([[True], (np.diff(at, axis=0) != 0).any(1)])]
                turn = np.sum(at[:-1, 0].astype(float) * at[1:, 1] - at[1:, 0].astype(float) * at[:-1, 1])
                at = at if turn > 0 else at[::-1]
                edges += [dict(zip(("ax", "ay", "bx", "by"), e, strict=True)) for e in np.hstack([at[:-1], at[1:]]).tolist()]
            if edges:
                out.append({**{n: first[n] for n in names}, "edges": edges})
        return pd.DataFrame(out, columns=[*names, "edges"])

    return unite


def _swept(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line, at, lo, hi, net, up, down) of stretches of the lines that edges lie on: the pieces whose
    edge goes up (or to the right) and down there, -1 if there is none."""
    upright = F.col("ax") == F.col("bx")
    along = F.when(upright, F.struct(F.lit("x").alias("line"), F.col("ax").alias("at"), F.col("ay").alias("from"), F.col("by").alias("to"))).otherwise(
        F.struct(F.lit("y").alias("line"), F.col("ay").alias("at"), F.col("ax").alias("from"), F.col("bx").alias("to"))
    )
    rows = edges.where("ax = bx or ay = by").select(*keys, "piece", along.alias("s")).select(*keys, "piece", "s.*")
    rows = rows.select(*keys, "piece", "line", "at", F.least("from", "to").alias("lo"), F.greatest("from", "to").alias("hi"), (F.col("to") > F.col("from")).alias("up"))
    width = STEPS // BANDS
    rows = rows.withColumn("band", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    rows = rows.withColumns({"lo": F.greatest(F.col("lo"), F.col("band") * width), "hi": F.least(F.col("hi"), (F.col("band") + 1) * width)})
    sign = F.when(F.col("up"), 1).otherwise(-1)
    end = lambda c, step, piece: F.struct(F.col(c).alias("pos"), step.alias("step"), piece.alias("p"))
    marks = rows.select(*keys, "line", "at", "band", "up", F.explode(F.array(end("lo", sign, F.col("piece")), end("hi", -sign, F.lit(-1).cast("long")))).alias("m"))
    side = lambda up: F.max(F.when(F.col("up") == up, F.col("m.p")))  # noqa: E731  a piece that begins beats one that ends
    places = marks.groupBy(*keys, "line", "at", "band", F.col("m.pos").alias("lo")).agg(F.sum("m.step").alias("step"), side(True).alias("u"), side(False).alias("d"))
    order = Window.partitionBy(*keys, "line", "at", "band").orderBy("lo")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(-1))
    return places.select(*keys, "line", "at", "lo", F.lead("lo").over(order).alias("hi"), F.sum("step").over(upto).alias("net"), last("u").alias("up"), last("d").alias("down")).where("hi is not null")


def _slanted(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ax, ay, bx, by, net, up, down) of the other edges, which pieces share from end to end or not at
    all: from their left end to their right one, and the pieces whose edge goes that way and back."""
    forward = F.col("ax") < F.col("bx")
    ends = [F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))]
    rows = edges.where("ax <> bx and ay <> by").select(*keys, "piece", forward.alias("forward"), *ends)
    side = lambda way: F.coalesce(F.max(F.when(F.col("forward") == way, F.col("piece"))), F.lit(-1))
    return rows.groupBy(*keys, "ax", "ay", "bx", "by").agg(F.sum(F.when(F.col("forward"), 1).otherwise(-1)).alias("net"), side(True).alias("up"), side(False).alias("down"))


def chained(edges: np.ndarray) -> list[np.ndarray]:
    """Directed edges (n x 4) as rings, without vertices in the middle of straight lines. Where rings touch in
    a point, the sharpest turn to the left is taken, so they stay apart."""
    leaving: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, (ax, ay, _, _) in enumerate(edges.tolist()):
        leaving[ax, ay].append(k)
    way = np.arctan2((edges[:, 3] - edges[:, 1]).astype(float), (edges[:, 2] - edges[:, 0]).astype(float))
    used, rings = np.zeros(len(edges), dtype=bool), []
    for start in range(len(edges)):
        if used[start]:
            continue
        ring, at = [], start
        while not used[at]:
            used[at] = True
            ring.append(edges[at, :2])
            out = [k for k in leaving[tuple(edges[at, 2:].tolist())] if not used[k] or k == start]
            if not out:
                break
            at = max(out, key=lambda k: ((way[k] - way[at] + np.pi) % (2 * np.pi), -k))
        points = np.array(ring)
        while True:
            a, b = points - np.roll(points, 1, axis=0), np.roll(points, -1, axis=0) - points
            bends = a[:, 0].astype(object) * b[:, 1] != a[:, 1].astype(object) * b[:, 0]
            if bends.all() or not len(points):
                break
            points = points[bends.astype(bool)]
        if len(points) >= 3:
            rings.append(np.vstack([points, points[:1]]))
    return rings


def _polygon(names: Sequence[str], origin: tuple[float, float, float]):
    def build(group: pd.DataFrame) -> pd.DataFrame:
        from reefline.geo import kernel as K

        rings = [r * origin[2] + np.array(origin[:2]) for r in chained(group[["ax", "ay", "bx", "by"]].to_numpy(np.int64))]
        rings.sort(key=lambda r: -abs(K.ring_area(r)))
        if not rings:
            return pd.DataFrame(columns=[*names, "geometry"])
        return pd.DataFrame([{**{n: group.iloc[0][n] for n in names}, "geometry": K.to_wkb([rings])}])

    return build


def dissolve_parts(df: DataFrame, keys: Sequence[str], geometry: str = "geometry", tree: Quadtree | None = None, capacity: int = 2_000) -> DataFrame:
    """(keys, geometry): the union of each key's shapes, a row and polygon for each connected part, its holes
    after its outer ring. Parts that meet in a point only are parts of their own. Null keys and shapes and
    empty shapes are left out; a shape that is given several times counts once."""
    rows = df.select(*keys, F.col(geometry).alias("_g")).dropna(subset=[*keys, "_g"]).distinct().withColumn("_b", st_bounds("_g")).where("_b.minx is not null")
    tree = tree or quadtree(rows.select("_b.*"), capacity)
    origin = _step(tree)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    in_leaf = dealt(rows, tree).select(*keys, "_g", "_leaf.*")
    united = in_leaf.groupBy(*keys, "leaf").applyInPandas(_pieces(keys, origin), f"{ddl}edges array<struct<ax:long,ay:long,bx:long,by:long>>")
    pieces = scratch_table(united.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    edges = pieces.select(*keys, "piece", F.explode("edges").alias("e")).select(*keys, "piece", "e.*")
    lines = scratch_table(_swept(edges, keys), "lines")
    slanted = scratch_table(_slanted(edges, keys), "slanted")
    shared = lines.select("up", "down").unionByName(slanted.select("up", "down")).where("up >= 0 and down >= 0 and up <> down")
    label = components(shared.select(F.col("up").alias("a"), F.col("down").alias("b")))
    forward = F.col("net") > 0
    start, end = F.when(forward, F.col("lo")).otherwise(F.col("hi")), F.when(forward, F.col("hi")).otherwise(F.col("lo"))
    upright = F.col("line") == "x"
    straight = lines.where("net <> 0").select(
        *keys, F.when(forward, F.col("up")).otherwise(F.col("down")).alias("piece"),
        F.when(upright, F.col("at")).otherwise(start).alias("ax"), F.when(upright, start).otherwise(F.col("at")).alias("ay"), F.when(upright, F.col("at")).otherwise(end).alias("bx"), F.when(upright, end).otherwise(F.col("at")).alias("by"),
    )
    turned = [F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))]
    boundary = straight.unionByName(slanted.where("net <> 0").select(*keys, F.when(forward, F.col("up")).otherwise(F.col("down")).alias("piece"), *turned))
    labelled = boundary.join(label, F.col("piece") == F.col("node"), "left").withColumn("part", F.coalesce("component", "piece"))
    return labelled.groupBy(*keys, "part").applyInPandas(_polygon(keys, origin), f"{ddl}geometry binary")
