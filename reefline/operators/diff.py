"""Snapshot differences of protected areas: parents and children, change rules, new, changed and deleted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.functions.numbers import stored
from reefline.functions.text import identifier

KEYS = ["environment", "wdpaid", "wdpa_p_id", "zone_id", "location"]
RELATION = ["wdpaid", "wdpa_p_id", "zone_id", "environment", "location"]


def with_relations(rows: DataFrame, first_source: str = "Protected Planet", second_source: str = "MPATLAS") -> DataFrame:
    """parent and children of rows of one (location, environment, wdpaid): the best row is the parent of
    the others. Best: the first source's own record, any of the first source, the second source's own
    record, any other; then by wdpa_p_id and zone_id. Rows without a wdpaid leave the table."""
    own = F.coalesce(F.col("wdpaid").cast("string") == F.col("wdpa_p_id").cast("string"), F.lit(False))
    first, second = F.col("data_source") == first_source, F.col("data_source") == second_source
    rank = F.when(first & own, 0).when(first, 1).when(second & own, 2).otherwise(3)
    group = ["location", "environment", "wdpaid"]
    order = [rank, F.col("wdpa_p_id").asc_nulls_last(), F.col("zone_id").asc_nulls_last()]
    me = F.struct(*RELATION)
    ranked = rows.where("wdpaid is not null").withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    ranked = ranked.withColumn("_first", F.first(me).over(Window.partitionBy(*group).orderBy("_n")))
    # The list is made once for each group and goes to its first row, not to all of them.
    lists = ranked.where("_n > 1").groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]).agg(F.array_sort(F.collect_list(F.struct("_n", me.alias("c")))).alias("_l"))
    on = (F.col("_n") == 1) & F.col("location").eqNullSafe(F.col("_g0")) & F.col("environment").eqNullSafe(F.col("_g1")) & (F.col("wdpaid") == F.col("_g2"))
    parent = F.when(F.col("_n") > 1, F.col("_first"))
    return ranked.join(lists, on, "left").select(*rows.columns, parent.alias("parent"), F.transform("_l", lambda x: x["c"]).alias("children"))


def string_changed(old: Column, new: Column) -> Column:
    """A new value that is there and differs. A value that is gone is no change."""
    return new.isNotNull() & ~old.eqNullSafe(new)


def number_changed(old: Column, new: Column) -> Column:
    """A new value that is there where none was, or that differs by more than one percent, at two decimals."""
    a, b = stored(old), stored(new)
    relative = F.when(a == 0, F.when(b != 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(F.abs(b - a) / a)
    return F.coalesce(b.isNotNull() & (a.isNull() | (relative > 0.01)), F.lit(False))


def parent_changed(old: Column, new: Column) -> Column:
    """One side without a relation, one without an id, or different ids."""
    one_side = old.isNull() != new.isNull()
    return one_side | F.coalesce(old.isNotNull() & new.isNotNull() & ~old["documentId"].eqNullSafe(new["documentId"]), F.lit(False))


def children_changed(old: Column, new: Column) -> Column:
    """One side without a list, other lengths, any child without an id, or other ids in any order."""
    ids = lambda c: F.transform(c, lambda x: x["documentId"])
    missing = lambda c: F.exists(ids(c), lambda v: v.isNull())
    one_side = old.isNull() != new.isNull()
    inside = (F.size(old) != F.size(new)) | missing(old) | missing(new) | (F.array_sort(F.array_distinct(ids(old))) != F.array_sort(F.array_distinct(ids(new))))
    return one_side | F.coalesce(old.isNotNull() & new.isNotNull() & inside, F.lit(False))


@dataclass
class Changes:
    new: DataFrame
    changed: DataFrame
    deleted: DataFrame  # documentId
    columns: DataFrame  # identifier and a flag for each compared column


def latest(current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the largest documentId of each identifier, documentIds of the others)."""
    marked = current.withColumn("_last", F.max("documentId").over(Window.partitionBy("identifier")))
    return marked.where("documentId = _last").drop("_last"), marked.where("documentId <> _last").select("documentId")


def attach_ids(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Adds the stored documentId to parent and children structs (null for those not stored yet)."""
    ids = current.select(F.col("identifier").alias("_stored"), F.col("documentId").alias("_id"))
    out = rows
    if "parent" in rows.columns:
        parent_key = F.when(F.col("parent").isNotNull(), identifier(*[F.col(f"parent.{k}") for k in KEYS]))
        out = out.withColumn("_key", parent_key).join(ids, F.col("_key") == F.col("_stored"), "left").drop("_stored")
        out = out.withColumn("parent", F.when(F.col("parent").isNotNull(), F.struct(*[F.col(f"parent.{k}").alias(k) for k in RELATION], F.col("_id").alias("documentId")))).drop("_key", "_id")
    if "children" in rows.columns:
        child = out.where("children is not null").select(F.col("identifier").alias("_row"), F.posexplode("children").alias("_at", "_c"))
        child = child.withColumn("_key", identifier(*[F.col(f"_c.{k}") for k in KEYS])).join(ids, F.col("_key") == F.col("_stored"), "left")
        lists = child.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", F.struct(*[F.col(f"_c.{k}").alias(k) for k in RELATION], F.col("_id").alias("documentId")).alias("c")))).alias("_l"))
        out = out.join(lists, F.col("identifier") == F.col("_row"), "left").withColumn("children", F.transform("_l", lambda x: x["c"])).drop("_row", "_l")
    return out


def snapshot_diff(current: DataFrame, updated: DataFrame, *, numbers: tuple[str, ...] = ("area", "coverage"), ignore: tuple[str, ...] = ("bbox",)) -> Changes:
    """What turns ``current`` (with documentId) into ``updated``. Both are matched by an identifier of
    environment, ids and location; current rows that share one are duplicates of the last and deleted."""
    now, doubles = latest(current.withColumn("identifier", identifier(*KEYS)))
    then = attach_ids(updated.withColumn("identifier", identifier(*KEYS)), now)
    gone = now.join(then.select("identifier"), "identifier", "left_anti").select("documentId")
    pair = now.alias("o").join(then.alias("n"), "identifier")
    flags = {}
    for c in updated.columns:
        if c in ignore or (c not in current.columns):
            continue
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}")
        rule = {"parent": parent_changed, "children": children_changed}.get(c, number_changed if c in numbers else string_changed)
        flags[c] = rule(old, new)
    any_flag = F.lit(False)
    for f in flags.values():
        any_flag = any_flag | f
    values = [stored(F.col(f"n.{c}")).alias(c) if c in numbers else F.col(f"n.{c}").alias(c) for c in updated.columns]
    return Changes(
        new=then.join(now.select("identifier"), "identifier", "left_anti").drop("identifier"),
        changed=pair.where(any_flag).select(F.col("o.documentId").alias("documentId"), *values),
        deleted=gone.unionByName(doubles).distinct(),
        columns=pair.select("identifier", *[f.alias(c) for c, f in flags.items()]),
    )


def upsert(stored_rows: DataFrame, changes: DataFrame, key: list[str], removed: DataFrame | None = None) -> DataFrame:
    """Rows replaced or added by key, and those removed taken out."""
    kept = stored_rows.join(changes.select(*key).distinct(), key, "left_anti")
    if removed is not None:
        kept = kept.join(removed.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def with_rejects(rows: DataFrame, dimensions: dict[str, tuple[DataFrame, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows with ids, rejected rows with errors). ``dimensions``: row column -> (table, code, id column
    to add). A code that isn't in its table is an error, as is one that stands there for several ids; a null
    one isn't. Rows are never doubled."""
    out, errors = rows, []
    for c, (dim, code, id_col) in dimensions.items():
        found = dim.groupBy(F.col(code).alias(f"_k_{c}")).agg(F.min("id").alias(id_col), (F.min("id") < F.max("id")).alias(f"_many_{c}"))
        out = out.join(found, F.col(c) == F.col(f"_k_{c}"), "left")
        shown, missing = F.col(c).cast("string"), F.col(c).isNotNull() & F.col(id_col).isNull()
        errors.append(F.when(missing, F.concat(F.lit(f"{c} not found: "), shown)).when(F.col(f"_many_{c}"), F.concat(F.lit(f"{c} is ambiguous: "), shown)))
    out = out.withColumn("errors", F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>"))
    out = out.drop(*[f"_{x}_{c}" for c in dimensions for x in ("k", "many")])
    return out.where(F.size("errors") == 0).drop("errors"), out.where(F.size("errors") > 0)
