"""Embedding near-duplicates as an exact metric range join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so a cosine threshold is a distance r. Pivots part the
vectors into cells (each vector's home is its nearest pivot), in two levels: near the first pivots, each has some of its
own, and a vector looks only at those of the first ones it visits. On either level a vector within r of one whose home is
another cell lies, by the triangle inequality, at most 2r farther from that cell's pivot than from its
own, and at most r from the plane between the two pivots; and it lies at most r farther from that pivot than
the farthest vector of its cell does. Where these bounds allow it, it is replicated into that cell. Cells then join on their own: each vector meets every possible partner exactly once, in
the partner's home cell.

A cell that holds very many vectors is cut into blocks of homes times blocks of visitors, so no task gets
more than two blocks. Equal vectors are one row with a weight. A block returns a row for each vector that
has links (their weight and the component within the block), never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import kept, workspace, written
from reefline.llm.graph import components

#: Pivots of both levels at most, the rows drawn to choose one, and numbers in either at most: what the driver
#: and the tasks hold. There is about one pivot for ``cell_rows`` rows, so cells grow only beyond this many.
PIVOTS = 1 << 14
SAMPLE = 8
#: Pivots below a first one, about: what a vector is compared with at once.
LEVEL = 2048
NUMBERS = 1 << 23
#: Visitors that are compared at once.
STRIP = 256


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, key, unit): unit vectors as bytes; key and unit are null where nothing can link."""

    def prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for label, vector in zip(batch.column(1), batch.column(2), strict=True):
                v = None
                if label.is_valid and vector.is_valid and not vector.values.null_count and len(vector.values):
                    v = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(v).max()
                    v = v / top if np.isfinite(v).all() and top > 0 else None
                if v is None:
                    keys.append(None)
                    units.append(None)
                else:
                    unit = ((v / np.sqrt(v @ v)) + 0.0).astype("<f8").tobytes()
                    units.append(unit)
                    keys.append(hashlib.blake2b(unit + repr(label.as_py()).encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "label", "key", "unit"])

    return vectors.mapInArrow(prepare, "vec_id long, label string, key binary, unit binary")


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of ``sample`` far from one another."""
    chosen, far = [0], np.full(len(sample), np.inf)
    for _ in range(min(n, len(sample)) - 1):
        far = np.minimum(far, 1 - sample @ sample[chosen[-1]])
        chosen.append(int(far.argmax()))
    return sample[chosen]


@dataclass(frozen=True)
class Pivots:
    """First pivots and, for each, those below it; the radii of their cells (how far their vectors lie from
    them, -1 where there are none) once they are known."""

    first: np.ndarray
    below: list[np.ndarray]
    first_radius: np.ndarray | None = None
    radius: list[np.ndarray] | None = None

    @staticmethod
    def of(sample: np.ndarray, n: int, level: int = LEVEL) -> Pivots:
        """About n pivots from a sample, about ``level`` of them below each first one: as few first ones as
        that takes, as a vector between two of those visits many cells."""
        first = spread(sample, -(-n // level))
        home = (sample @ first.T).argmax(1)
        own = [sample[home == k] for k in range(len(first))]  # none where first pivots are equal
        return Pivots(first, [spread(o, max(1, round(n * len(o) / len(sample)))) if len(o) else first[k : k + 1] for k, o in enumerate(own)])

    @property
    def strip(self) -> int:
        """So many vectors at once that their distances to all pivots of a level take 16 MB."""
        return max(1, (1 << 21) // max(map(len, (self.first, *self.below))))

    def radii(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cells' radii over the vectors x alone."""
        d = apart(x, self.first)
        home = d.argmin(1)
        first, below = np.full(len(self.first), -1.0), [np.full(len(p), -1.0) for p in self.below]
        np.maximum.at(first, home, d[np.arange(len(x)), home])
        for k in np.unique(home).tolist():
            own = apart(x[home == k], self.below[k])
            at = own.argmin(1)
            np.maximum.at(below[k], at, own[np.arange(len(own)), at])
        return first, below

    def cells(self, x: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, numbers of cells, whether one is the row's home), by first pivot: the cells that unit vectors
        within r of those of x may have for a home."""
        near, visits = visited(x, self.first, r, self.first_radius)
        for k, below in enumerate(self.below):
            rows = np.flatnonzero(visits[:, k])
            if len(rows):
                own, inner = visited(x[rows], below, r, None if self.radius is None else self.radius[k])
                own = np.where(near[rows] == k, own, -1)
                at = np.flatnonzero(own >= 0)
                inner[at, own[at]] = True
                i, cell = np.nonzero(inner)
                yield rows[i], cell + (k << 32), own[i] == cell


def apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))


def visited(x: np.ndarray, pivots: np.ndarray, r: float, radius: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, which pivots' cells may hold a vector within r) of unit vectors: such a vector lies
    nearer to its pivot than to any other, and no farther from it than the cell's radius."""
    d = apart(x, pivots)
    home = d.argmin(1)
    own = d[np.arange(len(x)), home][:, None]
    between = np.maximum(apart(pivots[home], pivots), 1e-6)
    visits = (d <= own + 2 * r) & ((d - own) * (d + own) / (2 * between) <= r)
    if radius is not None:
        visits &= d <= radius + r
    return home, visits


def with_radii(classes: DataFrame, pivots: dict[int, Pivots]) -> dict[int, Pivots]:
    """The pivots with their cells' radii over all vectors: a task returns a row for each cell it has met."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[tuple[int, int, int], float] = {}
        for batch in batches:
            by_size: dict[int, list[bytes]] = {}
            for u in batch.column(0).to_pylist():
                by_size.setdefault(len(u), []).append(u)
            for s, units in by_size.items():
                step = pivots[s].strip
                for k in range(0, len(units), step):
                    part = units[k : k + step]
                    first, below = pivots[s].radii(np.frombuffer(b"".join(part), "<f8").reshape(len(part), -1))
                    for i in np.flatnonzero(first >= 0).tolist():
                        most[s, i, -1] = max(most.get((s, i, -1), -1.0), float(first[i]))
                        for j in np.flatnonzero(below[i] >= 0).tolist():
                            most[s, i, j] = max(most.get((s, i, j), -1.0), float(below[i][j]))
        if most:
            keys = np.array(list(most))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(keys[:, 2]), pa.array(list(most.values()))], ["s", "i", "j", "d"])

    found = classes.select("unit").mapInArrow(measure, "s long, i long, j long, d double").groupBy("s", "i", "j").agg(F.max("d").alias("d"))
    first = {s: np.full(len(p.first), -1.0) for s, p in pivots.items()}
    below = {s: [np.full(len(q), -1.0) for q in p.below] for s, p in pivots.items()}
    for row in found.collect():  # a row a pivot
        if row.j < 0:
            first[row.s][row.i] = row.d
        else:
            below[row.s][row.i][row.j] = row.d
    return {s: Pivots(p.first, p.below, first[s], below[s]) for s, p in pivots.items()}


def pivots_for(classes: DataFrame, cell_rows: int) -> dict[int, Pivots]:
    """Pivots for each length of vectors, from a bounded sample; about one for ``cell_rows`` rows."""
    size = F.octet_length("unit")
    sizes = {r[0]: r[1] for r in classes.groupBy(size.alias("s")).count().collect()}
    out = {}
    for s, n in sizes.items():
        most = max(NUMBERS // (s // 8), 1)
        pivots = min(PIVOTS, 1 + n // cell_rows, max(most // SAMPLE, 1))
        rows = max(SAMPLE * pivots, min(2048, most))
        drawn = classes.where((size == s) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1, rows / n) * (1 << 30)))).select("unit").limit(2 * rows)
        sample = np.array([np.frombuffer(r[0], "<f8") for r in drawn.collect()] or [np.eye(1, s // 8)[0]])
        out[s] = Pivots.of(sample, pivots)
    return out


def block_links(threshold: float):
    """(n_links, component) of each vector that has links between a block of visitors and one of homes."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        homes, visitors = group[group.home], group[~group.home]
        none = pd.DataFrame({"rep": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "part": np.zeros(0, np.int64)})
        if homes.empty or visitors.empty:
            return none
        h, v = (np.frombuffer(b"".join(x.unit), "<f8").reshape(len(x), -1) for x in (homes, visitors))
        hid, vid = homes.rep.to_numpy(), visitors.rep.to_numpy()
        weight = homes.weight.to_numpy()
        n = np.zeros(len(vid), dtype=np.int64)
        linked_h = np.zeros(len(hid), dtype=bool)
        bits = []  # the links, a bit each
        for k in range(0, len(vid), STRIP):
            hit = (v[k : k + STRIP] @ h.T >= threshold) & (vid[k : k + STRIP, None] != hid)
            n[k : k + STRIP] = hit @ weight
            linked_h |= hit.any(0)
            bits.append((k, np.packbits(hit, axis=1)) if hit.any() else None)
        if not linked_h.any():
            return none
        # The smallest id within reach over the links of this block: a vector that is home and visitor
        # here has one place.
        ids, place = np.unique(np.concatenate([vid[n > 0], hid[linked_h]]), return_inverse=True)
        at_v, at_h = np.full(len(vid), -1), np.full(len(hid), -1)
        at_v[n > 0], at_h[linked_h] = place[: int((n > 0).sum())], place[int((n > 0).sum()) :]
        part = ids.copy()
        far = np.iinfo(np.int64).max
        while True:
            before = part.copy()
            for k, packed in filter(None, bits):
                hit = np.unpackbits(packed, axis=1, count=len(hid)).astype(bool)
                rows = np.flatnonzero(hit.any(1))
                hit, to_v = hit[rows], at_v[k + rows]
                least = np.minimum(np.where(hit, np.where(at_h >= 0, part[at_h], far), far).min(1), part[to_v])
                np.minimum.at(part, to_v, least)
                np.minimum.at(part, at_h[linked_h], np.where(hit, least[:, None], far).min(0)[linked_h])
            if (part == before).all():
                break
        own = pd.Series(n, index=vid)
        return pd.DataFrame({"rep": ids, "n": own.reindex(ids).fillna(0).to_numpy(np.int64), "part": part})

    return join


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    cosine: float = 0.93,
    cell_rows: int = 20_000,
    block_rows: int = 4096,
) -> DataFrame:
    """(id, n_links, component_id, kept): vectors of equal labels link if their cosine reaches ``cosine``.

    n_links counts the other vectors linked directly, component_id is the smallest id reachable by links,
    kept says whether it is the row's own. A vector that is null, empty or zero, or holds a null or
    non-finite component, and one without a label, links with nothing; vectors of different lengths don't
    link. Rows that repeat an id count as one vector each, with links and a component of their own. A row
    with a null id links with nothing. Other columns are ignored; an empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine lies between 0 and 1")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    with workspace(vectors.sparkSession, "embeddings"):
        return kept(_linked(source, cosine, cell_rows, block_rows).withColumnRenamed("vec_id", id_col), "embedding-result")


def _linked(source: DataFrame, cosine: float, cell_rows: int, block_rows: int) -> DataFrame:
    rows = written(prepared(source), "vectors")
    valid = rows.where("key is not null and vec_id is not null")
    # A class has a number of its own: ids may repeat with other vectors.
    classes = valid.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    pivots = with_radii(classes, pivots_for(classes, cell_rows))
    r = float(np.sqrt(2 - 2 * cosine)) + 1e-7  # a root of a rounded difference

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(3).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, u in enumerate(units):
                by_size.setdefault(len(u), []).append(i)
            strips = [(s, at[k : k + pivots[s].strip]) for s, at in by_size.items() for k in range(0, len(at), pivots[s].strip)]
            for s, at in strips:
                x, rows_of = np.frombuffer(b"".join(units[i] for i in at), "<f8").reshape(len(at), -1), np.array(at)
                for i, cell, is_home in pivots[s].cells(x, r):
                    # A home is there twice: its vector is a visitor in it too.
                    for picked, home in ((is_home, True), (np.ones(len(i), dtype=bool), False)):
                        sub = batch.take(pa.array(rows_of[i[picked]]))
                        names = pa.array([f"{s}:{c >> 32}:{c & 0xFFFFFFFF}" for c in cell[picked].tolist()], pa.string())
                        yield pa.RecordBatch.from_arrays([*sub.columns, names, pa.array(np.full(len(names), home))], ["rep", "weight", "label", "unit", "cell", "home"])

    dealt = written(classes.select("rep", "weight", "label", "unit").mapInArrow(deal, "rep long, weight long, label string, unit binary, cell string, home boolean"), "cells")
    sizes = written(dealt.groupBy("label", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors")), "cell-sizes")
    own, others = (F.ceil(F.col(c) / block_rows).cast("int") for c in ("homes", "visitors"))
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), own).otherwise(others)).cast("int")
    rest = F.sequence(F.lit(0), F.when(F.col("home"), others).otherwise(own) - 1)
    blocks = (
        dealt.join(sizes, ["label", "cell"]).where("homes > 0 and visitors > 0")
        .select("label", "cell", "rep", "weight", "unit", "home", mine.alias("mine"), F.explode(rest).alias("other"))
        .withColumns({"h": F.when(F.col("home"), F.col("mine")).otherwise(F.col("other")), "v": F.when(F.col("home"), F.col("other")).otherwise(F.col("mine"))})
        .select("label", "cell", "h", "v", "rep", "weight", "unit", "home")
    )
    found = written(blocks.groupBy("label", "cell", "h", "v").applyInPandas(block_links(cosine), "rep long, n long, part long"), "vector-links")
    parts = components(found, "rep", "part").select(F.col("node").alias("rep"), "component")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    part = written(classes.select("key", "rep", "first", "weight").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "class-parts")
    smallest = written(part.groupBy("component").agg(F.min("first").alias("component_id")), "smallest-ids")
    per_class = written(
        part.join(smallest, "component").join(counts, "rep", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "class-links"
    )
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(per_class, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
