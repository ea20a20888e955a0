"""Writes in chunks of a bounded number of ids, each tried again on its own."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reefline.sources.scratch import scratch_table

#: Fixed value: distinct ids of a chunk.
CHUNK = 10_000


def numbered(ids: DataFrame, key: str, size: int = CHUNK) -> DataFrame:
    """(key, chunk): distinct ids in ascending order, ``size`` to a chunk; null ids are left out.

    A dense rank over ranges: ids are dealt by range and counted by partition, and each one's place is the
    sum of the partitions before its own and its place there. What goes to one task is a row a partition.
    """
    ranged = ids.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(F.col(key)).sortWithinPartitions(key)
    # An id's number within its partition is what monotonically_increasing_id has below the partition's bits.
    placed = scratch_table(ranged.select(key, F.monotonically_increasing_id().alias("_m")), "chunk-ids").withColumns({"_p": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), "_p").select(key, F.floor((F.col("_before") + F.col("_at")) / size).cast("long").alias("chunk"))


def write_chunks(rows: DataFrame, key: str, sink: Callable[[int, list, pd.DataFrame], None], *, size: int = CHUNK, attempts: int = 3, wait: float = 1.0, removed: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(chunk, n_ids, n_rows, tries, error): deletes and then writes each chunk through ``sink(chunk, ids,
    rows)``, which gets all rows of a chunk's ids and must be able to run twice.

    A chunk that fails is tried again alone, later each time; what still fails has its error in the result,
    and nothing else waits for it. ``removed``: ids that are deleted without new rows. ``only``: chunk numbers
    (a column ``chunk``), such as those that failed before. Chunks depend on the ids alone, so the same input
    has the same chunks.
    """
    ids = rows.select(key) if removed is None else rows.select(key).union(removed.select(key))
    places = numbered(ids, key, size)
    if only is not None:
        places = places.join(F.broadcast(only.select("chunk").distinct()), "chunk", "left_semi")  # a number a chunk
    own = places.select(F.col(key).alias("_id"), "chunk").join(rows, F.col("_id") == F.col(key), "left")
    columns = rows.columns

    def send(group: pd.DataFrame) -> pd.DataFrame:
        chunk, error, tries = int(group["chunk"].iloc[0]), None, 0
        here = sorted(group["_id"].unique().tolist())
        new = group[group[key].notna()][columns]
        for tries in range(1, attempts + 1):
            try:
                sink(chunk, here, new)
                error = None
                break
            except Exception as e:  # told in the result
                error = f"{type(e).__name__}: {e}"
                if tries < attempts:
                    time.sleep(wait * 2 ** (tries - 1))
        return pd.DataFrame([(chunk, len(here), len(new), tries, error)], columns=["chunk", "n_ids", "n_rows", "tries", "error"])

    done = own.groupBy("chunk").applyInPandas(send, "chunk long, n_ids long, n_rows long, tries int, error string")
    return scratch_table(done, "chunks-done")  # written at once: a sink is no plan to be run again


def failed(done: DataFrame) -> DataFrame:
    return done.where("error is not null").select("chunk")
