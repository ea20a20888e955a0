"""Snapshot diffs, upserts, incremental and streaming flows."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.functions.text import identifier
from reefline.operators import diff
from reefline.plans.catalog import query, r6, table
from reefline.streaming import flows

_SOURCES = ("Protected Planet", "MPATLAS", "other")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as protected-area records: the customer is the site id, the order its part."""
    o = table(spark, sf_dir, "orders")
    source = F.element_at(F.array(*[F.lit(s) for s in _SOURCES]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    part = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderkey").cast("string"))
    return o.select(
        F.col("o_custkey").alias("wdpaid"), part.alias("wdpa_p_id"), F.col("o_orderkey").alias("zone_id"), F.lit("marine").alias("environment"),
        F.col("o_orderstatus").alias("location"), source.alias("data_source"), F.col("o_totalprice").alias("area"), F.col("o_orderpriority").alias("designation"),
    )


_RECORDS = """
SELECT o_custkey AS wdpaid, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS wdpa_p_id, o_orderkey AS zone_id,
       o_orderstatus AS location, CASE o_orderkey % 3 WHEN 0 THEN 'Protected Planet' WHEN 1 THEN 'MPATLAS' ELSE 'other' END AS data_source, o_totalprice AS area, o_orderpriority AS designation FROM orders
"""


@query(f"""
WITH d AS ({_RECORDS}), p AS (SELECT *, CASE WHEN data_source = 'Protected Planet' AND CAST(wdpaid AS VARCHAR) = wdpa_p_id THEN 0 WHEN data_source = 'Protected Planet' THEN 1
  WHEN data_source = 'MPATLAS' AND CAST(wdpaid AS VARCHAR) = wdpa_p_id THEN 2 ELSE 3 END AS rank FROM d),
w AS (SELECT *, ROW_NUMBER() OVER k AS n, FIRST_VALUE(zone_id) OVER k AS parent, COUNT(*) OVER (PARTITION BY location, wdpaid) AS size FROM p
  WINDOW k AS (PARTITION BY location, wdpaid ORDER BY rank, wdpa_p_id, zone_id))
SELECT zone_id, CASE WHEN n > 1 THEN parent END AS parent_zone, CAST(CASE WHEN n = 1 AND size > 1 THEN size - 1 END AS INTEGER) AS n_children FROM w
""")
def parents_and_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best record of each site and place is the parent of the others."""
    out = diff.with_relations(_records(spark, sf_dir))
    return out.select("zone_id", F.col("parent.zone_id").alias("parent_zone"), F.when(F.col("children").isNotNull(), F.size("children")).alias("n_children"))


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored snapshot and an updated one: some orders are gone, some new, some changed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    base = lambda d: d.select(F.col("o_orderkey").alias("wdpaid"), F.lit(None).cast("string").alias("wdpa_p_id"), F.lit(None).cast("long").alias("zone_id"), F.lit("marine").alias("environment"), F.col("o_orderstatus").alias("location"), F.col("o_orderpriority").alias("designation"), F.col("o_totalprice").alias("area"), F.col("o_orderkey"))
    k = F.col("o_orderkey")
    old = base(o.where(k % 10 != 0)).withColumn("documentId", F.concat(F.lit("doc"), k.cast("string"))).drop("o_orderkey")
    new = base(o.where(k % 11 != 0)).withColumn("area", F.when(k % 5 == 0, F.col("area") * 1.2).when(k % 5 == 1, F.col("area") * 1.005).otherwise(F.col("area")))
    new = new.withColumn("designation", F.when(k % 13 == 0, "changed").when(k % 13 == 1, F.lit(None)).otherwise(F.col("designation"))).drop("o_orderkey")
    return old, new


@query("""
SELECT 'new' AS op, o_orderkey AS wdpaid FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 11 <> 0
UNION ALL SELECT 'deleted', o_orderkey FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 = 0
UNION ALL SELECT 'changed', o_orderkey FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 <> 0 AND (o_orderkey % 5 = 0 OR (o_orderkey % 13 = 0 AND o_orderpriority <> 'changed'))
""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, deleted and changed records: a fifth more area is a change, half a percent isn't, nor is a value that went away."""
    c = diff.snapshot_diff(*_pair(spark, sf_dir))
    gone = c.deleted.select(F.lit("deleted").alias("op"), F.substring("documentId", 4, 30).cast("long").alias("wdpaid"))
    return c.new.select(F.lit("new").alias("op"), "wdpaid").unionByName(c.changed.select(F.lit("changed").alias("op"), "wdpaid")).unionByName(gone)


@query("""
SELECT CAST(SUM(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS area, CAST(SUM(CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS designation, CAST(0 AS BIGINT) AS location
FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 <> 0
""")
def changed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each column changed."""
    c = diff.snapshot_diff(*_pair(spark, sf_dir)).columns
    return c.agg(*[F.sum(F.col(k).cast("long")).alias(k) for k in ("area", "designation", "location")])


@query("""
SELECT o_orderkey, 'marine_' || CAST(o_orderkey AS VARCHAR) || '_<NA>_' || CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '<NA>' END AS identifier FROM orders
""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    part = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("double"))
    return o.select("o_orderkey", identifier(F.lit("marine"), F.col("o_orderkey"), F.lit(None).cast("string"), part).alias("identifier"))




@query("""
SELECT event_id, user_id, value FROM events WHERE event_id % 4 <> 0 AND event_id % 5 <> 0
UNION ALL SELECT event_id, user_id, ROUND(value * 2, 6) FROM events WHERE event_id % 4 = 0 AND event_id % 6 <> 0
""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows replaced by changes of their key, and removed ones taken out."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    stored = e.where("event_id % 5 <> 0 or event_id % 4 = 0")
    changes = e.where("event_id % 4 = 0 and event_id % 6 <> 0").withColumn("value", r6(F.col("value") * 2))
    removed = e.where("event_id % 4 = 0 and event_id % 6 = 0").select("event_id")
    return diff.upsert(stored, changes, ["event_id"], removed)


@query("""
WITH m AS (SELECT MIN(ts) + (MAX(ts) - MIN(ts)) / 2 AS mark FROM events) SELECT event_id, event_type FROM events, m WHERE ts > mark
""")
def changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the high-water mark."""
    e = table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    new, _ = flows.changed_since(e, lo + (hi - lo) / 2, "ts")
    return new.select("event_id", "event_type")


@query("""
SELECT user_id, 'fetch' AS what FROM (SELECT user_id, MAX(ts) AS t, MAX(CASE WHEN event_id % 2 = 0 THEN ts END) AS old FROM events GROUP BY 1) WHERE old IS NULL OR t > old
""")
def poll_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service's index against the stored table: which keys to fetch, which are gone (none here)."""
    e = table(spark, sf_dir, "events")
    index = e.groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    current = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    fetch, gone = flows.poll(index, current, "user_id")
    return fetch.select("user_id", F.lit("fetch").alias("what")).unionByName(gone.select("user_id", F.lit("gone").alias("what")))


@query("""
SELECT date_trunc('hour', ts) AS start, event_type, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2
""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flows.windowed(table(spark, sf_dir, "events"), size="1 hour", keys=["event_type"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(value), 4) AS total FROM events, (VALUES (0), (1)) s(k) GROUP BY 1
""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flows.windowed(table(spark, sf_dir, "events"), size="2 hours", slide="1 hour")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""
WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT user_id, ts, value, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, MIN(ts) AS start, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(value), 4) AS total FROM s GROUP BY user_id, k
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flows.sessions(table(spark, sf_dir, "events"), "user_id")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_id % 9 <> 0
""")
def streamed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of changes applied by micro-batch to a keyed table."""
    from reefline.sources import scratch
    from reefline.streaming import tables

    folder = scratch.folder(spark, "stream")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select(*e.columns)
    keyed = tables.KeyedTable(spark, f"{folder}/table", _ddl(e), ["user_id"], buckets=8)
    tables.stream_changes(stream, keyed, "event_id", f"{folder}/checkpoint", removed="event_id % 9 = 0").awaitTermination()
    return keyed.read()


def _ddl(df: DataFrame) -> str:
    return df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_id % 9 <> 0
""")
def two_streams_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams with checkpoints of their own feed one table, the newer half of the events first, in
    several batches each: late changes lose, and no batch is lost."""
    from reefline.sources import scratch
    from reefline.streaming import tables

    folder = scratch.folder(spark, "streams")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    keyed = tables.KeyedTable(spark, f"{folder}/table", "user_id long, event_id long, event_type string", ["user_id"], buckets=8)
    for name, half in (("new", "event_id % 2 = 1"), ("old", "event_id % 2 = 0")):
        e.where(half).repartitionByRange(3, F.col("event_id").desc()).write.parquet(f"{folder}/{name}")
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/{name}")
        tables.stream_changes(stream, keyed, "at", f"{folder}/checkpoint-{name}", removed="event_id % 9 = 0").awaitTermination()
    return keyed.read()


@query("""
SELECT l_orderkey, l_linenumber, 'part not found: ' || CAST(l_partkey AS VARCHAR) AS errors FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)
""")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose code has no entry in a dimension, with the error."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"))  # noqa: E741
    dim = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("code"), F.col("p_partkey").alias("id"))
    _, bad = diff.with_rejects(l, {"part": (dim, "code", "part_id")})
    return bad.select("l_orderkey", "l_linenumber", F.array_join("errors", ";").alias("errors"))


@query("""
SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 3
""")
def bulk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(o.where("id % 10 = 3"), "id", "left_anti")


