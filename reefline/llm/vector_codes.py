"""Codes of vectors by product quantisation in exact integers.

Components become integers, vectors are cut into equal parts, and each part position has a codebook. In
every round the codebooks' kd-trees are broadcast, tasks look up the nearest entry of each part by branch and
bound and return sums by entry, which Spark adds up. A tree has as many nodes as its codebook has entries at
most, so what is broadcast doesn't grow with the rows; the driver sees a row for each entry.

A box is left out only if it lies farther than the best entry so far. One that is equally far is visited,
as an entry of a lower index may be in it: ties go to the lower index, whatever the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import kept, workspace, written

#: Integers lie within this, so that no squared distance of up to 256 components leaves 64 bits.
MOST = 1 << 26
LEAF = 8
#: Vectors that are looked up at once.
STRIP = 8192

Batches = Iterable[pa.RecordBatch]


@dataclass(frozen=True)
class KdTree:
    """Nodes as arrays: boxes, children (-1 in a leaf) and the entries of leaves in order of their index."""

    entries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    members: list[np.ndarray]

    @staticmethod
    def of(entries: np.ndarray) -> KdTree:
        low, high, children, members = [], [], [], []

        def grow(own: np.ndarray) -> int:
            at = len(low)
            own_low, own_high = entries[own].min(0), entries[own].max(0)
            low.append(own_low)
            high.append(own_high)
            children.append((-1, -1))
            members.append(np.sort(own))
            axis = int((own_high - own_low).argmax())
            if len(own) > LEAF and own_low[axis] < own_high[axis]:
                order = own[np.argsort(entries[own, axis], kind="stable")]
                children[at] = (grow(order[: len(own) // 2]), grow(order[len(own) // 2 :]))
            return at

        grow(np.arange(len(entries)))
        return KdTree(entries, np.array(low), np.array(high), np.array(children), members)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the entry nearest to each row; of equally near ones the lowest index."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.full(len(x), len(self.entries))

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            own = x[rows]
            gap = np.maximum(np.maximum(self.low[node] - own, own - self.high[node]), 0)
            return (gap * gap).sum(1)

        def visit(node: int, rows: np.ndarray, far: np.ndarray) -> None:
            rows = rows[far <= best[rows]]  # equally far too
            if not len(rows):
                return
            left, right = self.children[node]
            if left < 0:
                member = self.members[node]
                apart = x[rows, None, :] - self.entries[member]
                d = (apart * apart).sum(2)
                at = d.argmin(1)
                d, k = d[np.arange(len(rows)), at], member[at]
                better = (d < best[rows]) | ((d == best[rows]) & (k < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], k[better]
                return
            to_left, to_right = bound(left, rows), bound(right, rows)
            first = to_left <= to_right
            for own, order in ((first, ((left, to_left), (right, to_right))), (~first, ((right, to_right), (left, to_left)))):
                for child, d in order:
                    visit(child, rows[own], d[own])

        visit(0, np.arange(len(x)), np.zeros(len(x), dtype=np.int64))
        return index, best


def integers(scale: int):
    """(id, label, v): floor(scale * x) of each vector as bytes; null where it is null or a component isn't a number."""

    def prepare(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for vector in b.column(2):
                v = None
                if vector.is_valid and not vector.values.null_count:
                    v = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    with np.errstate(over="ignore"):
                        v = np.clip(np.floor(v * scale), -MOST, MOST).astype("<i4").tobytes() if np.isfinite(v).all() else None
                out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["id", "label", "v"])

    return prepare


def _strips(batches: Batches, column: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, len(batch), STRIP):
            b = batch.slice(k, STRIP)
            yield b, np.frombuffer(b"".join(b.column(column).to_pylist()), "<i4").astype(np.int64).reshape(len(b), parts, -1)


def sums(trees, parts: int, entries: int, width: int):
    """(part, entry, n, s): for each entry that is the nearest of some, their number and componentwise sum."""

    def add(batches: Batches) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for _, x in _strips(batches, 0, parts):
            for p, tree in enumerate(trees.value):
                index, _ = tree.nearest(x[:, p])
                np.add.at(total[p], index, x[:, p])
                count[p] += np.bincount(index, minlength=entries)
        p, k = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p), pa.array(k), pa.array(count[p, k]), pa.array(total[p, k].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "s"]
            )

    return add


def encoded(trees, parts: int):
    """(id, label, code, error) of vectors."""

    def encode(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b, x in _strips(batches, 2, parts):
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees.value)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            error = np.sum([f[1] for f in found], 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return encode


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts x entries x width): the parts of the vectors with the smallest ids, ties by the vector's bytes."""
    order = [F.col("id").isNull(), "id", "v"]
    sized = rows.where(f"octet_length(v) > 0 and octet_length(v) % {4 * parts} = 0")
    length = sized.select("id", "v", F.octet_length("v").alias("size")).orderBy(*order).limit(1).collect()
    if not length:
        return np.zeros((parts, 0, 1), dtype=np.int64)
    first = sized.where(F.octet_length("v") == length[0].size).select("id", "v").orderBy(*order).limit(entries).collect()
    return np.array([np.frombuffer(r.v, "<i4") for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    scale: int = 1024,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error) of the vectors, and the codebooks (part, entry, component).

    A vector that is null or holds a null or non-finite component is dropped, as is one whose length differs
    from that of the kept vector with the smallest id; that one's length is a positive multiple of ``parts``.
    Integers beyond 2^26 count as 2^26. Codebooks start as the parts of the first ``entries`` vectors by id
    (null last), equal ids by their vectors; with fewer vectors they are shorter. label_error sums the errors
    of equal labels, nulls together. Rows that repeat an id have a code each. Other columns are ignored; an
    empty table gives no rows and codebooks without entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    spark = vectors.sparkSession
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    source = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    with workspace(spark, "vector-codes"):
        rows = written(source.mapInArrow(integers(scale), f"id {id_type}, label {label_type}, v binary").where("v is not null"), "integers")
        books = first_codebooks(rows, parts, entries)
        count, width = books.shape[1:]
        rows = rows.where(F.octet_length("v") == 4 * parts * width)
        components = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]
        for _ in range(rounds if count else 0):
            trees = spark.sparkContext.broadcast([KdTree.of(b) for b in books])
            found = rows.select("v").mapInArrow(sums(trees, parts, count, width), "part long, entry long, n long, s array<long>")
            books = books.copy()
            for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *components).collect():
                books[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
            trees.unpersist()
        trees = spark.sparkContext.broadcast([KdTree.of(b) for b in books] if count else [])
        codes = written(rows.mapInArrow(encoded(trees, parts), f"id {id_type}, label {label_type}, code string, error long") if count else _no_codes(rows), "codes")
        by_label = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
        out = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
        return kept(out.withColumnsRenamed({"id": id_col, "label": label_col}), "vector-codes"), books


def _no_codes(rows: DataFrame) -> DataFrame:
    return rows.where("false").select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))


def digest(books: np.ndarray) -> str:
    """SHA-256 of the codebooks' integers in decimal by part, entry and component, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
