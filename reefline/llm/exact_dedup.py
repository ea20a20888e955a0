"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Rows are logged with the digest of their normalised text. Each batch is dealt into memtables of a bounded
number of rows in one pass; a memtable flushes a sorted run of (digest, smallest and largest id, rows) with a
Bloom filter on the digest. A level that has ``fanout`` runs is compacted into one run of the next level: digests that no other run's filter
knows pass through unshuffled, only the others are grouped. Batches may be added to an index at any time.

Hits are digests with more than one row. Rows find them through a filter, so the texts that nothing equals
are never joined; the texts of hits are compared byte for byte before they count as equal.

Skew: every aggregation combines before its shuffle, so a text that a third of all rows share crosses
the network once per task, and the one join on the digest can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import BITMAP_BITS, IdFilter, ascii_lower, flagged, id_filter, id_filters, kept, maybe_in, workspace, written

#: Rows of a memtable, about: those of its sorted run at most.
MEMTABLE = 1 << 26
RUN = ("_digest", "_low", "_high", "_n")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def merged(rows: DataFrame) -> DataFrame:
    """Rows of runs, one for each digest: its smallest and largest identifier and how many rows have it."""
    return rows.groupBy("_digest").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_n").alias("_n"))


@dataclass
class Run:
    """A sorted run; its filter is made when it is first asked for."""

    rows: DataFrame
    _filter: IdFilter | None = None

    @staticmethod
    def flush(rows: DataFrame, name: str) -> Run:
        """Writes a run; Parquet keeps the range of digests of each file and row group."""
        return Run(written(rows.sortWithinPartitions("_digest"), name))

    @property
    def filter(self) -> IdFilter:
        if self._filter is None:
            found = id_filter(self.rows, "_digest")
            self._filter = IdFilter(written(found.bitmaps.coalesce(1), "lsm-filter"), found.bits)
        return self._filter


def known_elsewhere(runs: list[Run]) -> DataFrame:
    """The rows of all runs, each with whether another run's filter knows its digest (``_known``). Filters
    are looked up together, those of one size by one join."""
    rows = reduce(DataFrame.unionByName, [r.rows.select(*RUN, F.lit(k).alias("_own")) for k, r in enumerate(runs)]).withColumn("_known", F.lit(False))
    sizes: dict[int, list[int]] = {}
    for k, r in enumerate(runs):
        sizes.setdefault(r.filter.bits, []).append(k)
    for bits, own in sizes.items():
        maps = reduce(DataFrame.unionByName, [runs[k].filter.bitmaps.select("__bucket", F.struct(F.lit(k).alias("k"), F.col("__bitmap").alias("b")).alias("__f")) for k in own])
        maps = maps.groupBy("__bucket").agg(F.collect_list("__f").alias("__fs"))  # one of each run
        h = F.pmod(F.xxhash64("_digest"), F.lit(bits))
        rows = rows.withColumns({"__bucket": F.floor(h / BITMAP_BITS).cast("long"), "__bit": (h % BITMAP_BITS).cast("int")}).join(F.broadcast(maps), "__bucket", "left")
        byte = "cast(conv(hex(substring(f.b, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)"
        found = F.expr(f"coalesce(exists(__fs, f -> f.k <> _own and (shiftright({byte}, __bit % 8) & 1) = 1), false)")
        rows = rows.withColumn("_known", F.col("_known") | found).drop("__bucket", "__bit", "__fs")
    return rows


def split(runs: list[Run]) -> tuple[DataFrame, DataFrame]:
    """(rows that no other run's filter knows, the rest)."""
    rows = known_elsewhere(runs)
    return rows.where("not _known").select(*RUN), rows.where("_known").select(*RUN)


def compact(runs: list[Run], name: str) -> Run:
    """One run of all. A digest that only one run can have passes through; the others are grouped."""
    alone, shared = split(runs)
    return Run.flush(alone.unionByName(merged(shared)), name)


@dataclass
class LsmIndex:
    """Runs by level. Its tables are in the workspace of the caller, or in the shared folder without one.
    ``rows``: of a memtable at most, about; there are ``memtables`` of a batch at least."""

    memtables: int = 4
    fanout: int = 4
    rows: int = MEMTABLE
    levels: list[list[Run]] = field(default_factory=list)

    def add(self, log: DataFrame) -> None:
        """Adds a written batch of (_id, _digest); a memtable holds the rows of a range of id hashes. All
        memtables of a batch are made in one pass over it, and so are their filters."""
        tables = max(self.memtables, -(-log.count() // self.rows))
        run = F.pmod(F.xxhash64("_id"), F.lit(tables)).cast("int").alias("_run")
        own = log.groupBy(run, "_digest").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.count("*").alias("_n"))
        stored = written(own.sortWithinPartitions("_run", "_digest"), "lsm-memtables", partition="_run")
        filters = id_filters(stored, "_run", "_digest")
        filters = IdFilter(written(filters.bitmaps.coalesce(1), "lsm-filters"), filters.bits)
        for k in range(tables):
            self._put(Run(stored.where(F.col("_run") == k).select(*RUN), IdFilter(filters.bitmaps.where(F.col("_run") == k).select("__bucket", "__bitmap"), filters.bits)), 0)

    def _put(self, run: Run, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(compact(runs, f"lsm-level{level + 1}"), level + 1)

    def run(self) -> Run | None:
        """One run of all levels: what a major compaction leaves."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            runs = [compact(runs, "lsm-major")]
            self.levels = [[] for _ in self.levels] + [runs]
        return runs[0] if runs else None


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "largest",
    memtables: int = 4,
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row for each input row: (id, keep_id, group_size long, kept boolean, digest binary).

    ``keep``: which identifier of equal texts stays, "largest" or "smallest". A null text counts as
    empty. Rows with a null id get a null keep_id and are never kept unless all of their group's ids
    are null; ids are expected to be unique (rows that repeat an id repeat in the result). An empty
    table gives an empty result; other columns are ignored, so their names don't matter.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    pick, side = (F.max, "_high") if keep == "largest" else (F.min, "_low")
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col))
    with workspace(df.sparkSession, "lsm"):
        log = written(source.select("_id", digest(norm).alias("_digest")), "lsm-log")
        index = LsmIndex(memtables, max(memtables, 2))
        index.add(log)
        # Rows find the hits through their filter.
        hits = written(index.run().rows.where("_n > 1").select("_digest", F.col(side).alias("_keep"), "_n"), "lsm-hits")
        marked = flagged(log, id_filter(hits, "_digest"), "_digest")
        found = marked.where("__maybe").select("__row.*").join(hits, "_digest", "left").select("_id", "_digest", F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_n", F.lit(1)).alias("_n"))
        found = written(found, "lsm-found")
        single = marked.where("not __maybe").select("__row.*").select("_id", "_digest", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"))

        # Byte verification: the texts of hits are grouped by their bytes, copies combined before the shuffle.
        asked = found.where("_n > 1").select("_id")
        texts = maybe_in(source, id_filter(asked, "_id"), "_id").select("_id", norm.alias("_norm"))
        verified = texts.groupBy(digest(F.col("_norm")).alias("_digest"), "_norm").agg(F.count("*").alias("_vn"))
        clashes = written(verified.groupBy("_digest").agg(F.count("*").alias("_texts")).where("_texts > 1").select("_digest"), "lsm-clashes")
        out = found
        if not clashes.isEmpty():
            # Digests that several texts share: those rows are grouped by their texts instead.
            alone = found.join(clashes, "_digest", "left_anti").select("_id", "_digest", "_keep", "_n")
            rows = source.select("_id", norm.alias("_norm")).withColumn("_digest", digest(F.col("_norm"))).join(clashes, "_digest", "left_semi")
            groups = rows.groupBy("_norm").agg(pick("_id").alias("_keep"), F.count("*").alias("_n"))
            out = alone.unionByName(rows.join(groups, "_norm").select("_id", "_digest", "_keep", "_n"))
        out = single.unionByName(out).select(
            F.col("_id").alias(id_col),
            F.col("_keep").alias("keep_id"),
            F.col("_n").alias("group_size"),
            F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
            F.col("_digest").alias("digest"),
        )
        return kept(out, "lsm-result")
