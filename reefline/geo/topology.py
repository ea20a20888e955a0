"""Simplification that keeps what shapes share.

Shapes are taken apart into arcs: chains of edges that the same shapes share, between nodes, the vertices
where other shapes or more than two edges meet. Each arc is simplified once, whoever owns it, and shapes are
put together again from their arcs, so neighbours keep one border and no gaps or slivers arise.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.operators.components import components
from reefline.sources.scratch import scratch_table

_EDGES = "array<struct<p:int,r:int,ax:double,ay:double,bx:double,by:double>>"


def _edges():
    @F.pandas_udf(_EDGES)
    def run(w: pd.Series) -> pd.Series:
        from reefline.geo import kernel as K

        out = []
        for x in w:
            rows = []
            for p, rings in enumerate(K.polygons(K.from_wkb(x))):
                for r, ring in enumerate(rings):
                    for (ax, ay), (bx, by) in zip(ring[:-1].tolist(), ring[1:].tolist(), strict=True):
                        if (ax, ay) != (bx, by):
                            a, b = sorted(((ax, ay), (bx, by)))
                            rows.append({"p": p, "r": r, "ax": a[0], "ay": a[1], "bx": b[0], "by": b[1]})
            out.append(rows)
        return pd.Series(out)

    return run


def chain(edges: np.ndarray) -> np.ndarray:
    """Edges (n x 4) of one arc as a line of points; a closed one begins and ends with its smallest vertex."""
    near: dict[tuple, list[tuple]] = defaultdict(list)
    for ax, ay, bx, by in edges.tolist():
        near[ax, ay].append((bx, by))
        near[bx, by].append((ax, ay))
    ends = sorted(v for v, own in near.items() if len(own) == 1)
    start = ends[0] if ends else min(near)
    line, before, at = [start], None, start
    while True:
        ahead = [v for v in near[at] if v != before] or ([] if len(near[at]) < 2 else [before])
        if not ahead or (len(line) > 1 and at == start):
            break
        before, at = at, min(ahead) if len(line) == 1 else ahead[0]
        line.append(at)
    return np.array(line)


def thinned(points: np.ndarray, tolerance: float, keep_one: bool) -> np.ndarray:
    """The points of a line that are farther than ``tolerance`` from what is left without them. A closed line
    keeps three corners, and with ``keep_one`` any line one point between its ends."""
    n = len(points)
    if n <= 2:
        return points
    keep = np.zeros(n, dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, n - 1, 0)]
    closed = bool((points[0] == points[-1]).all())
    while todo:
        i, j, depth = todo.pop()
        if j - i < 2:
            continue
        a, d = points[i], points[j] - points[i]
        rest = points[i + 1 : j] - a
        length = float(np.hypot(*d))
        far = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / length if length else np.hypot(rest[:, 0], rest[:, 1])
        k = int(far.argmax())
        forced = (closed and depth < 1) or (closed and depth == 1 and keep.sum() < 4) or (keep_one and depth == 0)
        if far[k] > tolerance or (forced and far[k] > 0):
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k, depth + 1), (i + 1 + k, j, depth + 1)]
    return points[keep]


def _lines():
    def run(group: pd.DataFrame) -> pd.DataFrame:
        line = chain(group[["ax", "ay", "bx", "by"]].to_numpy())
        return pd.DataFrame([{"arc": group["arc"].iloc[0], "owners": group["owners"].iloc[0], "xs": line[:, 0].tolist(), "ys": line[:, 1].tolist()}])

    return run


def _thin(tolerance: float):
    @F.pandas_udf("xs array<double>, ys array<double>")
    def run(xs: pd.Series, ys: pd.Series, keep_one: pd.Series) -> pd.DataFrame:
        out = [thinned(np.column_stack([x, y]), tolerance, bool(k)) for x, y, k in zip(xs, ys, keep_one, strict=True)]
        return pd.DataFrame({"xs": [p[:, 0].tolist() for p in out], "ys": [p[:, 1].tolist() for p in out]})

    return run


def ring_of(lines: list[np.ndarray]) -> np.ndarray | None:
    """A ring put together from its arcs; None if nothing is left of it."""
    rest = sorted(lines, key=lambda p: p.tolist())
    ring = rest.pop(0)
    while rest:
        at = next((k for k, p in enumerate(rest) if (p[0] == ring[-1]).all() or (p[-1] == ring[-1]).all()), None)
        if at is None:
            return None
        p = rest.pop(at)
        ring = np.vstack([ring, p[1:] if (p[0] == ring[-1]).all() else p[::-1][1:]])
    return ring if len(ring) >= 4 and (ring[0] == ring[-1]).all() else None


def _rebuilt():
    def run(group: pd.DataFrame) -> pd.DataFrame:
        from reefline.geo import kernel as K

        by_ring: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for p, r, xs, ys in zip(group["p"], group["r"], group["xs"], group["ys"], strict=True):
            by_ring[p, r].append(np.column_stack([xs, ys]))
        made: dict[int, list[np.ndarray]] = defaultdict(list)
        for (p, r), lines in sorted(by_ring.items()):
            ring = ring_of(lines)
            if ring is not None and K.ring_area(ring) != 0 and (r == 0 or made[p]):
                made[p].append(ring)
        return pd.DataFrame([{"class": group["class"].iloc[0], "geometry": K.to_wkb([rings for rings in made.values() if rings])}])

    return run


def simplify_shared(shapes: DataFrame, tolerance: float, geometry: str = "geometry") -> DataFrame:
    """``shapes`` with simplified geometries whose common borders stay common.

    Borders are common where shapes have the same edges. Nodes stay, one more point of arcs that would else
    fall on one line, and three corners of a ring without nodes, so no shape vanishes. Two arcs may cross if
    the tolerance is wider than what lies between them. Null and empty geometries stay as they are; equal
    geometries are worked on once.
    """
    known = scratch_table(shapes.select(F.col(geometry).alias("_g")).where("_g is not null").distinct().withColumn("class", F.monotonically_increasing_id()), "shapes")
    edges = known.select("class", F.explode(_edges()("_g")).alias("e")).select("class", "e.*")
    ends = ["ax", "ay", "bx", "by"]
    owned = edges.groupBy(*ends).agg(F.array_sort(F.collect_set(F.struct("class", "p", "r"))).alias("owners"))
    owned = scratch_table(owned.withColumns({"edge": F.monotonically_increasing_id(), "key": F.xxhash64("owners")}), "edges")
    at = F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
    vertices = owned.select("edge", "key", at.alias("v")).groupBy("v").agg(F.count("*").alias("n"), F.min("edge").alias("a"), F.max("edge").alias("b"), F.min("key").alias("k"), F.max("key").alias("l"))
    label = components(vertices.where("n = 2 and k = l").select("a", "b"))
    arcs = owned.join(label, F.col("edge") == F.col("node"), "left").select(F.coalesce("component", "edge").alias("arc"), "owners", *ends)
    lines = scratch_table(arcs.groupBy("arc").applyInPandas(_lines(), "arc long, owners array<struct<class:long,p:int,r:int>>, xs array<double>, ys array<double>"), "arcs")
    pair = F.array_sort(F.array(F.struct(F.col("xs")[0].alias("x"), F.col("ys")[0].alias("y")), F.struct(F.element_at("xs", -1).alias("x"), F.element_at("ys", -1).alias("y"))))
    paired = scratch_table(lines.withColumns({"ends": pair, "t": _thin(tolerance)("xs", "ys", F.lit(False))}), "thinned")
    # Arcs that would become one and the same straight line keep a point.
    flat = F.size("t.xs") == 2
    often = paired.where(flat).groupBy("ends").agg(F.count("*").alias("n")).where("n > 1").select("ends", F.lit(True).alias("twin"))
    marked = paired.join(often, "ends", "left").withColumn("twin", flat & F.coalesce("twin", F.lit(False)))
    bent = marked.where("twin").select("owners", _thin(tolerance)("xs", "ys", F.lit(True)).alias("t"))
    thin = marked.where("not twin").select("owners", "t").unionByName(bent)
    rings = thin.select(F.explode("owners").alias("o"), "t.*").select("o.*", "xs", "ys")
    made = scratch_table(rings.groupBy("class").applyInPandas(_rebuilt(), "class long, geometry binary"), "rebuilt")
    new = known.join(made.withColumnRenamed("geometry", "_new"), "class").select("_g", "_new")
    columns = [F.coalesce("_new", geometry).alias(c) if c == geometry else F.col(c) for c in shapes.columns]
    return shapes.join(new, F.col(geometry) == F.col("_g"), "left").select(*columns)
