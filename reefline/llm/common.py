"""What the operators of this subpackage share: written tables, text rules, bounded id filters."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of an id filter at most: what is broadcast is a bit for each, 32 MB.
FILTER_BITS = 1 << 28
BITMAP_BITS = 8 * 4096  # what bitmap_construct_agg holds in one bitmap


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    temporary one; on a cluster executors would each write to their own disk, so it is an error there."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reefline-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


#: The folders of the operators that are under way in this thread, the innermost last.
_FOLDERS: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())


def new_path(spark: SparkSession, name: str) -> str:
    folders = _FOLDERS.get()
    return f"{folders[-1] if folders else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[None]:
    """A folder for the tables an operator writes on its way, deleted at its end; what is to outlive it is
    written by ``kept``. Shuffle files go when the driver's collector finds their plans gone, so it runs."""
    path = new_path(spark, name)
    token = _FOLDERS.set((*_FOLDERS.get(), path))
    try:
        yield
    finally:
        _FOLDERS.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        gc.collect()
        spark._jvm.System.gc()


def written(df: DataFrame, name: str, *, partition: str | None = None, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends there, so a lost
    executor costs no recomputation beyond it. ``partition``: a column by whose values files are kept apart."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.options(**options)
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, outside the current workspace."""
    token = _FOLDERS.set(_FOLDERS.get()[:-1])
    try:
        return written(df, name)
    finally:
        _FOLDERS.reset(token)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table. They go as Arrow: a list of rows would pass through Python workers
    of another kind, for which each executor keeps a second set of processes."""
    if not rows:
        return spark.createDataFrame([], schema)
    kinds = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.table([pa.array(c) for c in zip(*rows, strict=True)], kinds.names), kinds)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of few rows for what runs inside: texts of many lengths keep a worker's memory small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` gives the same on pure ASCII and is much faster there."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


@dataclass(frozen=True)
class IdFilter:
    """A Bloom filter (one hash) as rows (bucket, bitmap): 16 bits for each id, ``FILTER_BITS`` at most."""

    bitmaps: DataFrame
    bits: int


def bits_for(ids: int) -> int:
    return 1 << min(max(int(16 * ids).bit_length(), 16), FILTER_BITS.bit_length() - 1)


def id_filter(ids: DataFrame, *columns: str) -> IdFilter:
    """The filter of the values of some columns of a written table."""
    return _bitmaps(ids, bits_for(ids.count()), [], columns)


def id_filters(ids: DataFrame, part: str, *columns: str) -> IdFilter:
    """The filters of the parts of a written table, as one table with the column ``part``, all of one size."""
    most = ids.groupBy(part).count().agg(F.max("count")).first()[0] or 0
    return _bitmaps(ids, bits_for(most), [part], columns)


def _bitmaps(ids: DataFrame, bits: int, keys: list[str], columns: tuple[str, ...]) -> IdFilter:
    h = F.pmod(F.xxhash64(*columns), F.lit(bits))
    bitmaps = (
        ids.select(*keys, F.floor(h / BITMAP_BITS).cast("long").alias("__bucket"), (h % BITMAP_BITS).alias("__bit"))
        .groupBy(*keys, "__bucket")
        .agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))
    )
    return IdFilter(bitmaps, bits)


def flagged(df: DataFrame, known: IdFilter, *keys: Column | str) -> DataFrame:
    """(__row, __maybe): the rows as structs, so that no column's name can clash with these, and whether
    the values of the keys may be in the filter."""
    h = F.pmod(F.xxhash64(*[F.col(f"`{k}`") if isinstance(k, str) else k for k in keys]), F.lit(known.bits))
    byte = "cast(conv(hex(substring(__bitmap, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)"
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.floor(h / BITMAP_BITS).cast("long").alias("__bucket"), (h % BITMAP_BITS).cast("int").alias("__bit"))
    return rows.join(F.broadcast(known.bitmaps), "__bucket", "left").select("__row", F.expr(f"coalesce((shiftright({byte}, __bit % 8) & 1) = 1, false)").alias("__maybe"))


def maybe_in(df: DataFrame, known: IdFilter, *keys: Column | str) -> DataFrame:
    """Rows whose keys may be in the filter: never drops one that is. The broadcast side holds at most
    ``FILTER_BITS`` / 8 bytes."""
    return flagged(df, known, *keys).where("__maybe").select("__row.*")


def without(df: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """``df`` without the rows whose keys are in ``gone``, a written table with columns of the keys' names;
    nulls equal nulls. The first key's filter tells most rows apart from those; only the others are shuffled."""
    first = next(iter(keys))
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__own"), *[c.alias(names[k]) for k, c in keys.items()])
    marked = flagged(rows, id_filter(gone, first), names[first])
    known = gone.select(*keys).distinct()
    on = [F.col(f"__row.{names[k]}").eqNullSafe(F.col(k)) for k in keys]
    rest = marked.where("__maybe").join(known, on, "left_anti")
    return marked.where("not __maybe").select("__row.__own.*").union(rest.select("__row.__own.*"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
