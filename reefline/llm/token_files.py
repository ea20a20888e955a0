"""Token-id files in Simple-8b coding.

A file is a Parquet file whose rows are blocks of whole documents in id order. The ids of a block are
coded in runs of 256; each run begins at a word boundary and its first word is in the block's offsets,
so that all runs are decoded side by side. A 64-bit word holds a selector in its low 4 bits and n values
of b bits above it. Selector 0 is an escape: the next word is one raw 64-bit value.

Spark's writers and readers move the files, so they can lie in any store and a lost task is rerun.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reefline.llm.common import small_batches
from reefline.llm.tokenizing import word_bpe

#: (values, bits) of selectors 1 to 14.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
RUN = 256
BLOCK = "shard int, first_doc long, block int, ids_before long, n_ids long, doc_ids binary, null_ids binary, doc_lengths binary, run_words binary, words binary"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative ids -> (words, first word of each run and the number of words)."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    runs = -(-n // RUN)
    if not n:
        return np.zeros(0, dtype="<u8"), np.zeros(1, dtype="<u4")
    grid = np.zeros(runs * RUN + 60, dtype=np.uint64)
    grid[:n] = ids
    end = np.minimum((np.arange(runs) + 1) * RUN, n)
    last = np.repeat(end, RUN)[:n]
    # For each place the densest word that fits: the largest of the next 1, 2, 4, ... values, taken only as
    # far as denser words can fit; values beyond the run are 0 there.
    choice = np.zeros(n, dtype=np.uint8)
    room = last - np.arange(n)
    narrow = ids.astype(np.uint32) if int(ids.max()) < 1 << 32 else ids

    def with_next(largest: np.ndarray, shift: int) -> np.ndarray:
        beyond = np.zeros_like(largest)
        if n > shift:
            beyond[: n - shift] = largest[shift:]
        beyond[room <= shift] = 0
        return np.maximum(largest, beyond)

    largest, power = narrow, 1
    for k in range(len(SELECTORS), 0, -1):  # from one value a word to the densest
        count, bits = SELECTORS[k - 1]
        while power * 2 <= count:
            largest, power = with_next(largest, power), power * 2
        wide = largest if count == power else with_next(largest, count - power)
        fits = wide < (1 << bits) if bits < 32 or wide.dtype == np.uint64 else np.ones(n, dtype=bool)
        if not fits.any() and bits < 32:
            break  # denser words hold smaller values still
        choice[fits] = k
    counts = np.array([1, *(c for c, _ in SELECTORS)], dtype=np.int64)
    at = np.arange(runs) * RUN
    used = np.zeros(runs, dtype=np.int64)
    chosen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(runs)
    while len(active):
        here = at[active]
        sel = choice[here]
        chosen.append((active, here, used[active].copy()))
        used[active] += 1 + (sel == 0)
        at[active] += counts[sel]
        active = active[at[active] < end[active]]
    first = np.concatenate([[0], np.cumsum(used)])
    words = np.zeros(first[-1], dtype=np.uint64)
    run, here, nth = (np.concatenate(x) for x in zip(*chosen, strict=True))
    to, sel = first[run] + nth, choice[here]
    for k in np.unique(sel):
        m = sel == k
        if k == 0:
            words[to[m] + 1] = ids[here[m]]
            continue
        count, bits = SELECTORS[k - 1]
        word = np.full(int(m.sum()), k, dtype=np.uint64)
        start, stop = here[m], end[run[m]]
        for j in range(count):
            value = grid[start + j]
            value[start + j >= stop] = 0
            word |= value << np.uint64(4 + j * bits)
        words[to[m]] = word
    return words.astype("<u8"), first.astype("<u4")


def decode(words: np.ndarray, run_words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    words = np.asarray(words, dtype=np.uint64)
    sel = (words & np.uint64(15)).astype(np.int64)
    counts = np.array([1, *(c for c, _ in SELECTORS), 0], dtype=np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (sel == 0).any():  # a raw word may look like anything: escapes are told apart from it in order
        k = 0
        while k < len(words):
            hits = np.flatnonzero(sel[k:] == 0)
            if not len(hits):
                break
            k += int(hits[0]) + 1
            raw[k] = True
            k += 1
    each = np.where(raw, 0, counts[sel])
    upto = np.concatenate([[0], np.cumsum(each)])
    run = np.searchsorted(run_words[1:], np.arange(len(words)), side="right")
    to = upto[:-1] - upto[run_words[run]] + run * RUN
    stop = np.minimum((run + 1) * RUN, n)
    for k in np.unique(sel[~raw]):
        m = np.flatnonzero((sel == k) & ~raw)
        if k == 0:
            out[to[m]] = words[m + 1]
            continue
        count, bits = SELECTORS[k - 1]
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            fits = to[m] + j < stop[m]
            out[to[m][fits] + j] = (words[m][fits] >> np.uint64(4 + j * bits)) & mask
    return out


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, files: int | None = None) -> None:
    """Encodes every text, appends ``end_id`` and writes the files in ascending id order.

    Rows are dealt into ranges of ids (``files`` of them, else one for each shuffle partition), so files
    follow one another. Null ids come first; a null text counts as empty.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    ranged = source.repartitionByRange(files, F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first())

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), word_bpe()
        before = block = 0
        first = None
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # small groups of texts bound the memory of long ones
                texts, size, start = [], 0, at
                while at < batch.num_rows and size < 1 << 18:
                    texts.append(batch.column(1)[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                docs_ids = batch.column(0).slice(start, len(texts))
                ids, counts = coder.encode(texts)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                counts += 1
                bounds = np.concatenate([[0], np.cumsum(counts)])
                words, run_words = encode(ids)
                nulls = np.array([not x.is_valid for x in docs_ids])
                numbers = np.array(docs_ids.fill_null(0), dtype="<i8")
                if first is None:
                    first = None if nulls[0] else int(numbers[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in ((shard, pa.int32()), (first, pa.int64()), (block, pa.int32()), (before, pa.int64()), (len(ids), pa.int64()), (numbers.tobytes(), pa.binary()), (np.packbits(nulls).tobytes(), pa.binary()), (np.diff(bounds).astype("<u4").tobytes(), pa.binary()), (run_words.tobytes(), pa.binary()), (words.tobytes(), pa.binary()))],
                    ["shard", "first_doc", "block", "ids_before", "n_ids", "doc_ids", "null_ids", "doc_lengths", "run_words", "words"],
                )
                before += len(ids)
                block += 1

    with small_batches(spark):
        ranged.mapInArrow(blocks, BLOCK).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Decodes the files: (doc_id, start, n_tokens, ids_crc32) and, with ``with_ids``, the ids.

    ``start`` counts the ids of all documents before it: those of earlier files, summed from the blocks'
    numbers alone (a row for each file), and those before it in its own.
    """
    stored = spark.read.schema(BLOCK).parquet(path)
    per_file = stored.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    base = per_file.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_base"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["doc_lengths"], dtype="<u4").astype(np.int64)
                numbers = np.frombuffer(row["doc_ids"], dtype="<i8")
                nulls = np.unpackbits(np.frombuffer(row["null_ids"], dtype=np.uint8), count=len(numbers)).astype(bool)
                ids = decode(np.frombuffer(row["words"], dtype="<u8"), np.frombuffer(row["run_words"], dtype="<u4").astype(np.int64), row["n_ids"]).astype("<u4")
                ends = np.cumsum(lengths)
                data = [ids[a:b].tobytes() for a, b in zip(ends - lengths, ends, strict=True)]
                arrays = [
                    pa.array(np.full(len(lengths), row["shard"], dtype=np.int32)),
                    pa.array(numbers, mask=nulls),
                    pa.array(row["ids_before"] + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(d) for d in data], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(data, pa.binary())] * with_ids, ["shard", "doc_id", "_start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = "shard int, doc_id long, _start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    decoded = stored.mapInArrow(read, schema)
    return decoded.join(base, "shard").select(
        "doc_id", (F.col("_base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )
