"""Arrow functions over WKB columns."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from reefline.geo import kernel as K
from reefline.geo import slabs

PROJECTIONS = {
    "6933": K.equal_area,
    "3857": K.web_mercator,
    "mollweide": K.mollweide(K.SPHERE),
    "mollweide_wgs84": K.mollweide(K.A),
}
_INVERSES = {"6933": K.equal_area_inverse, "3857": K.web_mercator_inverse}


def _arrow(kind: str):
    """As pandas_udf, but made when first used: a type's text needs a session to be parsed."""

    def wrap(f):
        made: list = []

        def call(*columns: Column | str) -> Column:
            if not made:
                made.append(F.pandas_udf(f, kind))
            return made[0](*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap


_RECTANGLE = np.frombuffer(struct.pack("<BIII", 1, 3, 1, 5), dtype=np.uint8)
_POINT = np.frombuffer(struct.pack("<BI", 1, 1), dtype=np.uint8)


def flat(w: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4 bounds, whether it is a rectangle) of the points and upright rectangles of a batch, decoded
    all at once; NaN for other values. Grids, cells and positions are such."""
    values, sizes = w.to_numpy(), np.array([-1 if x is None else len(x) for x in w])
    out, is_box = np.full((len(values), 4), np.nan), np.zeros(len(values), dtype=bool)
    for head, points in ((_RECTANGLE, 5), (_POINT, 1)):
        size = len(head) + 16 * points
        at = np.flatnonzero(sizes == size)
        if not len(at):
            continue
        raw = np.frombuffer(b"".join(values[at]), dtype=np.uint8).reshape(-1, size)
        v = raw[:, len(head) :].copy().view("<f8").reshape(-1, points, 2)
        good = (raw[:, : len(head)] == head).all(1) & np.isfinite(v).all((1, 2))
        if points == 5:
            moves = np.diff(v, axis=1) != 0
            good &= (v[:, 0] == v[:, 4]).all(1) & (moves.sum(2) == 1).all(1) & (moves[:, :-1] != moves[:, 1:]).all((1, 2))
        out[at[good]] = np.hstack([v.min(1), v.max(1)])[good]
        is_box[at[good]] = points == 5
    return out, is_box


def rectangles(b: np.ndarray) -> np.ndarray:
    """WKB of n x 4 bounds."""
    x0, y0, x1, y1 = b.T
    v = np.stack([x0, y0, x1, y0, x1, y1, x0, y1, x0, y0], axis=1).astype("<f8").view(np.uint8).reshape(len(b), 80)
    raw = np.hstack([np.broadcast_to(_RECTANGLE, (len(b), len(_RECTANGLE))), v])
    out = np.empty(len(b), dtype=object)
    out[:] = [r.tobytes() for r in raw]
    return out


#: Bytes of WKB that are worked on at once.
_AT_ONCE = 1 << 20


def _lots(at: np.ndarray, *columns: pd.Series):
    """Rows ``at`` in lots of bounded size, each with its values, read."""
    values = [c.to_numpy()[at] for c in columns]
    sizes = np.array([sum(map(len, v)) for v in zip(*values, strict=True)], dtype=np.int64)
    for part in slabs.ranges(sizes, _AT_ONCE):
        yield at[part], [K.read(v[part]) for v in values]


def _unary(kind: str, f=None, of_flat=None, of_many=None):
    """``f``: one geometry to a value, or ``of_many``: a list of geometries to their values; ``of_flat``:
    (bounds, is rectangle) -> values for all points and rectangles of a batch."""

    @_arrow(kind)
    def run(w: pd.Series) -> pd.Series:
        out = np.full(len(w), None, dtype=object)
        left = w.notna().to_numpy()
        if of_flat is not None:
            b, is_box = flat(w)
            done = ~np.isnan(b[:, 0])
            out[done] = of_flat(b[done], is_box[done])
            left &= ~done
        for at, (gs,) in _lots(np.flatnonzero(left), w):
            values = of_many(gs) if of_many else [f(g) for g in gs]
            for i, v in zip(at.tolist(), values, strict=True):
                out[i] = v
        return pd.Series(out, dtype=object)

    return run


def _binary(kind: str, f=None, of_flat=None, of_many=None):
    """``f``: two geometries to a value, or ``of_many``: a list of pairs to their values; ``of_flat``: (bounds a,
    bounds b) -> values where both are points or rectangles, the second a rectangle."""

    @_arrow(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), None, dtype=object)
        left = (a.notna() & b.notna()).to_numpy()
        if of_flat is not None:
            (x, _), (y, is_box) = flat(a), flat(b)
            done = ~np.isnan(x[:, 0]) & is_box
            out[done] = of_flat(x[done], y[done])
            left &= ~done
        for at, (gs, hs) in _lots(np.flatnonzero(left), a, b):
            pairs = list(zip(gs, hs, strict=True))
            values = of_many(pairs) if of_many else [f(g, h) for g, h in pairs]
            for i, v in zip(at.tolist(), values, strict=True):
                out[i] = v
        return pd.Series(out, dtype=object)

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounds of the overlaps; crossed where there is none."""
    return np.hstack([np.maximum(a[:, :2], b[:, :2]), np.minimum(a[:, 2:], b[:, 2:])])


def _size(b: np.ndarray) -> np.ndarray:
    return np.maximum(b[:, 2] - b[:, 0], 0) * np.maximum(b[:, 3] - b[:, 1], 0)


def _shared_wkb(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = _shared(a, b)
    some = (s[:, 0] < s[:, 2]) & (s[:, 1] < s[:, 3])
    out = np.empty(len(s), dtype=object)
    out[:] = [K.to_wkb([])] * len(s)
    out[some] = rectangles(s[some])
    return out


def _lies_in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    point = (a[:, :2] == a[:, 2:]).all(1)
    inside = (a[:, :2] >= b[:, :2]).all(1) & (a[:, 2:] <= b[:, 2:]).all(1)
    return np.where(point, inside, _size(a) - _size(_shared(a, b)) <= 1e-9 * _size(a))


def _written(gs) -> list[bytes]:
    return [K.to_wkb(g) for g in gs]


st_area = _unary("double", of_flat=lambda b, _: _size(b), of_many=K.areas)
st_points = _unary("long", lambda g: sum(len(r) for p in g for r in p))
st_perimeter = _unary("double", K.perimeter)
st_make_valid = _unary("binary", of_many=lambda gs: _written(K.made_valid(gs)))
st_is_valid = _unary("boolean", of_many=K.are_valid)
def _repaired(gs) -> list[list[bytes]]:
    """The valid shape of each, or nothing. Exploded, it drops what can't be repaired; a filter on st_is_valid would
    be pushed below the repair and do it twice."""
    made = K.made_valid(gs)
    return [[K.to_wkb(g)] if ok else [] for g, ok in zip(made, K.are_valid(made), strict=True)]


st_repaired = _unary("array<binary>", of_many=_repaired)
st_geometry_type = _unary("string", K.kind)
st_polygons = _unary("binary", lambda g: K.to_wkb(K.polygons(g)))
st_fill_holes = _unary("binary", lambda g: K.to_wkb(K.fill_holes(g)))
st_intersects = _binary("boolean", K.intersects, lambda a, b: (lambda s: (s[:, :2] <= s[:, 2:]).all(1))(_shared(a, b)))
st_within = _binary("boolean", K.within, _lies_in)
PREDICATES = {"intersects": st_intersects, "within": st_within}
st_intersection = _binary("binary", of_flat=_shared_wkb, of_many=lambda pairs: _written(slabs.combined(pairs, lambda w: w[:, 0] & w[:, 1])))
st_difference = _binary("binary", of_many=lambda pairs: _written(slabs.combined(pairs, lambda w: w[:, 0] & ~w[:, 1])))
st_intersection_area = _binary("double", of_flat=lambda a, b: _size(_shared(a, b)), of_many=lambda pairs: slabs.combined_areas(pairs, lambda w: w[:, 0] & w[:, 1]))


def _solid_boxes(b: np.ndarray, _) -> np.ndarray:
    out = np.empty(len(b), dtype=object)
    out[:] = [[x] if some else [] for x, some in zip(rectangles(b), _size(b) > 0, strict=True)]
    return out


#: Array of the geometry, empty if it has no area. Exploded, it drops such rows; a filter on st_area would make the
#: optimizer work out the geometry twice.
st_solid = _unary("array<binary>", of_flat=_solid_boxes, of_many=lambda gs: [[K.to_wkb(g)] if a > 0 else [] for g, a in zip(gs, K.areas(gs), strict=True)])


@_arrow("minx double, miny double, maxx double, maxy double")
def st_bounds(w: pd.Series) -> pd.DataFrame:
    out, _ = flat(w)
    for at, (gs,) in _lots(np.flatnonzero(np.isnan(out[:, 0]) & w.notna().to_numpy()), w):
        out[at] = K.bounds_of(gs)
    return pd.DataFrame(out, columns=["minx", "miny", "maxx", "maxy"]).astype("Float64").where(~np.isnan(out), pd.NA)


@_arrow("x double, y double")
def st_centroid(w: pd.Series) -> pd.DataFrame:
    rows = [None if x is None else K.centroid(K.from_wkb(x)) for x in w]
    return pd.DataFrame([r or (None, None) for r in rows], columns=["x", "y"], dtype="float64")


@_arrow("binary")
def st_from_geojson(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else K.to_wkb(K.from_geojson(x)))


@_arrow("string")
def st_as_geojson(w: pd.Series) -> pd.Series:
    import json

    return w.map(lambda x: None if x is None else json.dumps(K.to_geojson(K.from_wkb(x))))


@_arrow("binary")
def st_box(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series(rectangles(np.column_stack([x0, y0, x1, y1])), dtype=object)


@_arrow("binary")
def st_point(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([K.to_wkb([[np.array([[a, b]])]]) for a, b in zip(x, y, strict=True)], dtype=object)


@_arrow("binary")
def st_buffer_km2(w: pd.Series, km2: pd.Series) -> pd.Series:
    """Points as circles of an area; other geometries stay."""
    out = np.full(len(w), None, dtype=object)
    for at, (gs,) in _lots(np.flatnonzero(w.notna()), w):
        out[at] = _written(K.buffered(gs, km2.to_numpy()[at]))
    return pd.Series(out, dtype=object)


def st_simplify(c: Column | str, tolerance: float) -> Column:
    return _unary("binary", lambda g: K.to_wkb(K.simplify(g, tolerance)))(c)


def st_transform(c: Column | str, to: str, *, inverse: bool = False) -> Column:
    """From longitude and latitude to a projection ("6933", "3857", "mollweide", "mollweide_wgs84") or back."""
    f = (_INVERSES if inverse else PROJECTIONS)[to]
    return _unary("binary", of_many=lambda gs: _written(K.transformed(gs, f)))(c)


def st_area_km2(c: Column | str, projection: str = "6933") -> Column:
    f = PROJECTIONS[projection]
    return _unary("double", of_many=lambda gs: K.areas(K.transformed(gs, f)) / 1e6)(c)


def st_cells(c: Column | str, size: float) -> Column:
    """Grid cells of the bounding box: array of (i, j)."""
    return _unary("array<struct<i:long,j:long>>", lambda g: [{"i": i, "j": j} for i, j in K.cells(g, size)])(c)


def st_subdivide(c: Column | str, most: int = 10_000) -> Column:
    return _unary("array<binary>", of_many=lambda gs: [_written(parts) for parts in K.subdivided(gs, most)])(c)


def st_tiles(c: Column | str, size: float) -> Column:
    return _unary("array<struct<i:long,j:long,part:binary>>", lambda g: [{"i": i, "j": j, "part": K.to_wkb(p)} for i, j, p in K.tiles(g, size)])(c)


@_arrow("binary")
def st_union_agg(w: pd.Series) -> bytes:
    parts = [K.from_wkb(x) for x in w if x is not None]
    return K.to_wkb(parts[0] if len(parts) == 1 and len(parts[0]) <= 1 else K.union(parts))


@_arrow("double")
def st_union_area_agg(w: pd.Series) -> float:
    return float(K.area([p for x in w if x is not None for p in K.from_wkb(x)]))


@_arrow("geometry binary, removed long")
def st_user_polygons(s: pd.Series) -> pd.DataFrame:
    """All valid polygons of an uploaded GeoJSON value and how many were removed. A ring is valid with four
    points or more, the last one equal to the first."""
    import json

    def found(d) -> tuple[list, int]:
        kind = d.get("type")
        inner = d.get("features") if kind == "FeatureCollection" else d.get("geometries") if kind == "GeometryCollection" else [d.get("geometry")] if kind == "Feature" else None
        if inner is not None:
            got = [found(x) for x in inner if x]
            return [p for ps, _ in got for p in ps], sum(n for _, n in got)
        candidates = [d["coordinates"]] if kind == "Polygon" else d["coordinates"] if kind == "MultiPolygon" else []
        good = [c for c in candidates if c and all(len(r) >= 4 and r[0] == r[-1] for r in c)]
        return good, len(candidates) - len(good) + (kind not in ("Polygon", "MultiPolygon"))

    rows = []
    for x in s:
        if x is None:
            rows.append((None, None))
            continue
        good, removed = found(json.loads(x))
        rows.append((K.to_wkb(K.from_geojson({"type": "MultiPolygon", "coordinates": good})) if good else None, removed))
    return pd.DataFrame(rows, columns=["geometry", "removed"]).astype({"removed": "Int64"})
