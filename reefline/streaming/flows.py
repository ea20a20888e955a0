"""Flows over changes and events: marks, polls, windows. Streams of upserts are in ``tables``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_since(rows: DataFrame, mark, at: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(rows changed after a mark, one row with the new mark). The mark is kept if nothing changed."""
    new = rows.where(F.col(at) > F.lit(mark)) if mark is not None else rows
    return new, new.agg(F.coalesce(F.max(at), F.lit(mark)).alias("mark"))


def poll(index: DataFrame, current: DataFrame, key: str, at: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(keys to fetch again, keys that are gone) of a service's index against the stored table."""
    old = current.select(F.col(key), F.col(at).alias("_old"))
    changed = index.join(old, key, "left").where(F.col("_old").isNull() | (F.col(at) > F.col("_old"))).select(key)
    return changed, current.join(index, key, "left_anti").select(key)


def windowed(events: DataFrame, at: str = "ts", *, size: str = "1 hour", slide: str | None = None, late: str = "2 hours", keys: list[str] | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding window, batch or stream; events later than ``late`` are
    dropped on streams."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return e.withWatermark(at, late).groupBy(w, *(keys or [])).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str, at: str = "ts", *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    return e.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
