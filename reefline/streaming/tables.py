"""A table that streams of changes are applied to.

Rows lie in buckets of their key. A version is a manifest: for each bucket the version it was last written
in, and for each stream that feeds the table its last batch. A batch rewrites only the buckets its keys fall
into and ends with writing the manifest, so a reader never sees half a batch, and one that runs again after
a failure is known by stream and number: a stream with a new checkpoint is another stream, whose batches
count from 0 without being mistaken for those of the first.

Each key keeps the mark (the value of the order column) of its last change, also after it was removed. A
change with a lower mark came late and changes nothing, in whatever batch and from whatever stream it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MANIFEST = "bucket long, version long, stream string, epoch long"
_INNER = ("_mark", "_gone", "_bucket")


class KeyedTable:
    """Versions of a table below a folder. ``keep``: older versions that stay readable."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Sequence[str], *, buckets: int = 64, keep: int = 2):
        self.spark, self.folder, self.schema, self.key, self.buckets, self.keep = spark, folder.rstrip("/"), schema, list(key), buckets, keep

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        """Versions with a complete manifest, ascending; there are ``keep`` + 1 at most between batches."""
        fs, at = self._fs(f"{self.folder}/manifests")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(self._fs(f"{self.folder}/manifests/{n}/_SUCCESS")[1]))

    def version(self) -> int:
        return max(self.versions(), default=-1)

    def _manifest(self, version: int | None = None) -> tuple[dict[int, int], dict[str, int]]:
        v = self.version() if version is None else version
        if v < 0:
            return {}, {}
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifests/v{v}").collect()  # a row for each bucket and stream
        return {r.bucket: r.version for r in rows if r.bucket is not None}, {r.stream: r.epoch for r in rows if r.stream is not None}

    def _rows(self, buckets: dict[int, int], mark: str | None) -> DataFrame:
        inner = f", _gone boolean{f', _mark {mark}' if mark else ''}"
        paths = [f"{self.folder}/v{v}/_bucket={b}" for b, v in sorted(buckets.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema + inner)
        return self.spark.read.schema(self.schema + inner).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._manifest(version)[0], None).where("not _gone").drop("_gone")

    def epoch(self, stream: str) -> int:
        """The last batch of a stream that is in the table; -1 if there is none."""
        return self._manifest()[1].get(stream, -1)

    def merge(self, changes: DataFrame, order: str, removed: str | None, stream: str, epoch: int) -> None:
        """Applies changes: of each key's the one with the highest mark holds, on equal marks one that arrives
        later. Rows for which ``removed`` (a SQL condition on the table's columns) holds are taken out."""
        current = self.version()
        known, streams = self._manifest(current)
        mark = changes.schema[order].dataType.simpleString()
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        gone = F.coalesce(F.expr(removed), F.lit(False)) if removed else F.lit(False)
        columns = [c for c in self.spark.createDataFrame([], self.schema).columns]
        new = changes.select(*columns, gone.alias("_gone"), F.col(order).alias("_mark"), F.lit(1).alias("_new"))
        touched = [r[0] for r in changes.select(bucket.alias("b")).distinct().collect()]  # at most the number of buckets
        old = self._rows({b: known[b] for b in touched if b in known}, mark).select(*columns, "_gone", "_mark", F.lit(0).alias("_new"))
        last = Window.partitionBy(*self.key).orderBy(F.col("_mark").desc_nulls_last(), F.col("_new").desc())
        merged = old.unionByName(new).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new").withColumn("_bucket", bucket)
        version = current + 1
        if touched:
            merged.repartition(min(len(touched), self.buckets), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/v{version}")
        state = [(b, version if b in touched else v, None, None) for b, v in {**known, **dict.fromkeys(touched, version)}.items()]
        state += [(None, None, s, e) for s, e in {**streams, stream: epoch}.items()]
        self.spark.createDataFrame(state, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifests/v{version}")
        self._forget()

    def _forget(self) -> None:
        """Deletes versions beyond ``keep`` older ones, and the data that no manifest names any more."""
        versions = self.versions()
        staying = versions[-(self.keep + 1) :]
        used = {v for s in staying for v in self._manifest(s)[0].values()}
        for v in versions[: -(self.keep + 1)]:
            fs, at = self._fs(f"{self.folder}/manifests/v{v}")
            fs.delete(at, True)
        fs, at = self._fs(self.folder)
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) <= versions[-1] and int(name[1:]) not in used:
                fs.delete(s.getPath(), True)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its stream: another checkpoint is another stream."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first().id


def stream_changes(changes: DataFrame, table: KeyedTable, order: str, checkpoint: str, *, removed: str | None = None, derive: Callable[[DataFrame], DataFrame] | None = None):
    """Applies a stream of changes to a table, see there. ``derive`` recomputes columns of a batch's rows."""

    def apply(batch: DataFrame, epoch: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        if table.epoch(stream) >= epoch:
            return  # run again after a failure between the manifest and the checkpoint's own note
        table.merge(derive(batch) if derive else batch, order, removed, stream, epoch)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
