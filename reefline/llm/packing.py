"""Best-two-fit packing of documents into sequences of fixed capacity.

A bin is filled greedily with the longest pieces that fit; before it closes, its smallest piece is
replaced by two unpacked pieces that fit the expanded gap more tightly, if there are such. What the
method decides depends on lengths alone, so it runs on the histogram of lengths (at most ``capacity``
rows, however large the corpus): each bin pattern it finds is repeated as often as the counts allow,
which is what it would do bin by bin. Pieces are then dealt to the places of their length by rank, in
parallel; the rank is counted by (length, salt), with as many salts as a length has pieces for, so a
length that most pieces share is no single group.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reefline.llm.common import kept, small_batches, small_table, workspace, written
from reefline.llm.tokenizing import byte_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: times in a bin}, bins) that pack ``counts`` pieces of each length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        left[length] = n
    places = np.arange(capacity + 1)
    patterns = []
    while left.any():
        free = left.copy()
        at_most = np.maximum.accumulate(np.where(free > 0, places, 0))  # the longest free length up to each
        items: Counter[int] = Counter()
        gap = capacity
        while (length := int(at_most[gap])) > 0:
            fits = min(int(free[length]), gap // length)
            items[length] += fits
            free[length] -= fits
            gap -= fits * length
            if not free[length]:
                at_most = np.maximum.accumulate(np.where(free > 0, places, 0))
        if gap and items:
            smallest = min(items)
            room = smallest + gap
            first = places[1:room]
            second = np.minimum(at_most[room - first], at_most[first])
            alone = (second == first) & (free[first] < 2)
            if alone.any():  # a pair of one length needs two pieces of it
                second[alone] = at_most[np.maximum(first[alone] - 1, 0)]
            total = np.where((free[first] > 0) & (second > 0), first + second, 0)
            if len(total) and total.max() > smallest:
                a = int(first[len(total) - 1 - np.argmax(total[::-1])])
                b = int(second[a - 1])
                items[smallest] -= 1
                items += Counter()  # drops a length with none left
                items[a] += 1
                items[b] += 1
        bins = min(int(left[length]) // n for length, n in items.items())
        for length, n in items.items():
            left[length] -= bins * n
        patterns.append((dict(items), bins))
    return patterns


def places_of(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset, pieces a sequence) for each pattern and length."""
    out, taken, sequence = [], Counter(), 0
    for items, bins in patterns:
        offset = 0
        for length, n in sorted(items.items(), reverse=True):
            out.append((length, taken[length], bins * n, sequence, offset, n))
            taken[length] += bins * n
            offset += length * n
        sequence += bins
    return out


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first one may be shorter than the capacity."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    return [(0, head)] * (head > 0) + [(s, capacity) for s in range(head, length, capacity)]


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, with_ids: bool) -> DataFrame:
    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe()
        for batch in batches:
            rows: list[tuple] = []
            ids_of: list[bytes] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), 0).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    rows.append((doc, k, start, length, zlib.crc32(data)))
                    if with_ids:
                        ids_of.append(data)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids_of, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(pieces, PIECES + (", ids binary" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int, rows_per_salt: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (1 to ``capacity``).

    ``pieces`` should be a written table: it is read twice. The driver gets the histogram of lengths,
    ``capacity`` rows at most, and hands back the places: a few rows for each length.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places = places_of(best_two_fit(counts, capacity))
    plan = small_table(spark, places or [(0, 0, 0, 0, 0, 1)], "_len long, _from long, _ranks long, _seq long, _offset long, _each long")
    salts = small_table(spark, [(n, 8 + count // rows_per_salt) for n, count in counts.items()] or [(0, 1)], "length long, _salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_salts"))).drop("_salts")
    before = (
        salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
        .withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_salt", F.coalesce("_base", F.lit(0)).alias("_base"))
    )
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    on = (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_ranks"))
    place = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(plan), on).select(
        *pieces.columns,
        (F.col("_seq") + F.expr("(_rank - _from) div _each")).alias("sequence_id"),
        (F.col("_offset") + place % F.col("_each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenizes ``docs``, cuts documents longer than ``capacity`` and packs the pieces.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``with_ids`` the ids as little-endian unsigned 32-bit integers. A null or empty text gives one piece
    that holds the end id only. Rows that repeat an id are packed each for itself; a null id stays null.
    An empty table gives no rows. Other columns are ignored.
    """
    with workspace(docs.sparkSession, "packing"):
        with small_batches(docs.sparkSession):
            pieces = written(tokenized_pieces(docs, id_col, text_col, capacity, with_ids), "pieces")
        return kept(pack(pieces, capacity), "packed")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences of a result that has ids: (sequence_id, ids binary, n_tokens)."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
        .select("sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), "n_tokens")
    )
