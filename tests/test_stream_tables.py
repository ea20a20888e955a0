"""Streams of changes: what a second checkpoint, late changes and a failure must not break."""

import os

import pytest
from pyspark.sql import functions as F

from reefline.streaming.tables import KeyedTable, stream_changes

SCHEMA = "id long, v string, n long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=4)


@pytest.fixture
def feed(spark, tmp_path, table):
    def run(changes, name="a", **options):
        if changes:
            spark.createDataFrame(changes, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        stream_changes(stream, table, "n", str(tmp_path / f"ck-{name}"), removed="v = 'gone'", **options).awaitTermination()

    return run


def test_last_change_holds(table, feed):
    feed([(1, "a", 1), (2, "b", 1), (1, "c", 2)])
    assert rows(table.read()) == [(1, "c", 2), (2, "b", 1)]
    feed([(2, "gone", 3), (3, "d", 1)])
    assert rows(table.read()) == [(1, "c", 2), (3, "d", 1)]
    before = table.version()
    feed([])
    assert table.version() == before


def test_new_checkpoint_on_an_old_table(table, feed):
    """Its batches count from 0 again, and none is taken for done."""
    feed([(1, "a", 1)])
    feed([(2, "b", 2)])
    feed([(3, "c", 3)], "other")
    assert rows(table.read()) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    feed([(4, "d", 4)])
    assert len(rows(table.read())) == 4


def test_late_changes_lose(table, feed):
    feed([(1, "new", 5), (2, "gone", 5)])
    feed([(1, "old", 4), (2, "old", 4)])
    feed([(1, "older", 1), (2, "older", 1)], "other")
    assert rows(table.read()) == [(1, "new", 5)]
    feed([(2, "back", 6), (1, "same mark", 5)])
    assert rows(table.read()) == [(1, "same mark", 5), (2, "back", 6)]


def test_batch_that_runs_again(spark, table, feed):
    """A failure after the data and before the manifest leaves the table as it was; one after the manifest
    is known by stream and batch."""
    feed([(1, "a", 1)])
    changes = spark.createDataFrame([(1, "b", 2), (5, "e", 1)], SCHEMA)
    changes.withColumns({"_gone": F.lit(False), "_mark": F.lit(9), "_bucket": F.lit(0)}).write.partitionBy("_bucket").parquet(f"{table.folder}/v{table.version() + 1}")
    assert rows(table.read()) == [(1, "a", 1)]
    table.merge(changes, "n", None, "s", 0)
    assert rows(table.read()) == [(1, "b", 2), (5, "e", 1)]
    assert table.epoch("s") == 0 and table.epoch("other") == -1


def test_buckets_and_retention(spark, table, tmp_path):
    for k in range(6):
        table.merge(spark.createDataFrame([(k, f"v{k}", k)], SCHEMA), "n", None, "s", k)
    assert table.versions() == [3, 4, 5]
    assert [len(rows(table.read(v))) for v in (3, 4, 5)] == [4, 5, 6]
    written = sum(name.startswith("_bucket") for v in os.listdir(table.folder) if v.startswith("v") for name in os.listdir(f"{table.folder}/{v}"))
    assert written <= 6  # a batch of one key writes one bucket
    table.merge(spark.createDataFrame([], SCHEMA), "n", None, "s", 6)
    assert len(rows(table.read())) == 6 and table.epoch("s") == 6


def test_null_keys_and_marks(spark, table):
    table.merge(spark.createDataFrame([(None, "x", None), (None, "y", 1), (7, "z", None), (7, "w", 0)], SCHEMA), "n", None, "s", 0)
    assert sorted((r.v for r in table.read().collect())) == ["w", "y"]


def test_derived_columns(table, feed):
    feed([(1, "a", 1)], derive=lambda df: df.withColumn("v", F.upper("v")))
    assert rows(table.read()) == [(1, "A", 1)]
