"""The read side: filters, sorts, pages, nested reads, aggregated statistics and what-if figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.functions.numbers import percent


def condition(spec: Mapping) -> Column:
    """A filter dict as a condition.

    Fields may be nested ({"location": {"code": {"$eq": "FRA"}}}); operators: $eq, $ne, $in, $notIn, $gt,
    $gte, $lt, $lte, $null, $notNull, $contains, $startsWith, $endsWith, $and, $or, $not.
    """
    simple = {
        "$eq": lambda c, v: c == F.lit(v),
        "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
        "$in": lambda c, v: c.isin(list(v)),
        "$notIn": lambda c, v: ~F.coalesce(c.isin(list(v)), F.lit(False)),
        "$gt": lambda c, v: c > F.lit(v),
        "$gte": lambda c, v: c >= F.lit(v),
        "$lt": lambda c, v: c < F.lit(v),
        "$lte": lambda c, v: c <= F.lit(v),
        "$null": lambda c, v: c.isNull() if v in (True, "true") else c.isNotNull(),
        "$notNull": lambda c, v: c.isNotNull() if v in (True, "true") else c.isNull(),
        "$contains": lambda c, v: F.contains(c, F.lit(v)),
        "$startsWith": lambda c, v: F.startswith(c, F.lit(v)),
        "$endsWith": lambda c, v: F.endswith(c, F.lit(v)),
    }

    def walk(node, path: str) -> Column:
        if not isinstance(node, Mapping):
            return F.col(path) == F.lit(node)
        parts = []
        for k, v in node.items():
            if k == "$and":
                parts.append(reduce(lambda a, b: a & b, [walk(x, path) for x in v], F.lit(True)))
            elif k == "$or":
                parts.append(reduce(lambda a, b: a | b, [walk(x, path) for x in v], F.lit(False)))
            elif k == "$not":
                parts.append(~walk(v, path))
            elif k in simple:
                parts.append(simple[k](F.col(path), v))
            elif k.startswith("$"):
                raise ValueError(f"unknown operator {k}")
            else:
                parts.append(walk(v, f"{path}.{k}" if path else k))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    return walk(spec, "")


def sort_spec(spec) -> list[tuple[str, bool]]:
    """[(path, ascending)] of "a:asc,b.c:desc", a list of such, or nested dicts."""
    if not spec:
        return []
    if isinstance(spec, str):
        items = [s.strip() for s in spec.split(",") if s.strip()]
        return [(p, d.lower() != "desc") for p, _, d in (i.partition(":") for i in items)]
    if isinstance(spec, Mapping):
        return [(f"{k}.{p}" if p else k, up) for k, v in spec.items() for p, up in (sort_spec(v) if isinstance(v, Mapping) else [("", str(v).lower() != "desc")])]
    return [x for s in spec for x in sort_spec(s)]


def sorted_rows(df: DataFrame, spec, *, last_dominates: bool = False) -> DataFrame:
    """Sorted with nulls last both ways. ``last_dominates``: as if sorted by one key after another."""
    keys = sort_spec(spec)
    if last_dominates:
        keys = keys[::-1]
    return df.orderBy(*[F.col(p).asc_nulls_last() if up else F.col(p).desc_nulls_last() for p, up in keys]) if keys else df


def page(df: DataFrame, *, limit: int | None = None, start: int | None = None, page: int | None = None, page_size: int | None = None, default: int = 25, most: int = 100_000) -> DataFrame:
    """A page of sorted rows; ``limit`` -1 means all of them."""
    if limit == -1:
        return df
    if limit is not None or start is not None:
        return df.offset(start or 0).limit(min(default if limit is None else limit, most))
    size = min(page_size or default, most)
    return df.offset(((page or 1) - 1) * size).limit(size)


def paging(df: DataFrame, page: int = 1, page_size: int = 25) -> DataFrame:
    """One row of page, pageSize, pageCount and total."""
    return df.agg(F.count("*").alias("total")).select(F.lit(page).alias("page"), F.lit(page_size).alias("pageSize"), F.ceil(F.col("total") / page_size).alias("pageCount"), "total")


def populate_one(df: DataFrame, other: DataFrame, key: str, other_key: str, fields: Sequence[str], name: str) -> DataFrame:
    """A to-one relation as a struct, null if there is none."""
    right = other.select(F.col(other_key).alias("_k"), F.struct(*fields).alias(name))
    return df.join(right, F.col(key) == F.col("_k"), "left").drop("_k")


def populate_many(df: DataFrame, other: DataFrame, key: str, other_key: str, fields: Sequence[str], name: str, where: Column | None = None) -> DataFrame:
    """A to-many relation as a sorted list of structs, empty if there is none."""
    rows = other.where(where) if where is not None else other
    right = rows.groupBy(F.col(other_key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    joined = df.join(right, F.col(key) == F.col("_k"), "left").drop("_k")
    empty = F.from_json(F.lit("[]"), right.schema[name].dataType)
    return joined.withColumn(name, F.coalesce(name, empty))


@dataclass(frozen=True)
class Relation:
    """A relation to read along: ``rows`` whose ``other_key`` equals the reader's ``key``, as a struct or, with
    ``many``, a sorted list; ``populate`` are relations of those rows."""

    rows: DataFrame
    key: str
    other_key: str
    fields: Sequence[str]
    many: bool = False
    where: Column | None = None
    populate: Mapping[str, Relation] = field(default_factory=dict)


def populate(df: DataFrame, relations: Mapping[str, Relation]) -> DataFrame:
    """Relations of any depth, from the innermost out; each is one aggregate (if many) and one left join."""
    out = df
    for name, r in relations.items():
        rows = populate(r.rows.where(r.where) if r.where is not None else r.rows, r.populate)
        read = populate_many if r.many else populate_one
        out = read(out, rows, r.key, r.other_key, [*r.fields, *r.populate], name)
    return out


def having(df: DataFrame, other: DataFrame, on: Column, direct: Column | None = None) -> DataFrame:
    """Rows that match themselves or have a related row that does; ``df`` keeps each row once."""
    semi = df.join(other, on, "left_semi")
    if direct is None:
        return semi
    return df.where(F.coalesce(direct, F.lit(False))).unionByName(semi.where(~F.coalesce(direct, F.lit(False))))


def active_flags(flags: DataFrame, at: Column) -> DataFrame:
    return flags.where((~F.coalesce(F.col("archived"), F.lit(False))) & (F.col("active_on").isNull() | (F.col("active_on") <= at)))


def aggregated_stats(stats: DataFrame, locations: DataFrame, codes: Sequence[str] | None = None, *, sub: str | None = None, protected: str = "protected_area") -> DataFrame:
    """Statistics of a set of locations by year, environment and, if given, a sub category.

    A missing or zero total falls back to the location's area of the environment. ``locations``: (code,
    total_marine_area, total_terrestrial_area, has_shared_marine_area). Rows come in no order: who shows
    them sorts by year.
    """
    rows = stats if codes is None else stats.where(F.col("location").isin([c.strip().upper() for c in codes]))
    loc = locations.select(F.col("code").alias("location"), "total_marine_area", "total_terrestrial_area", "has_shared_marine_area")
    rows = rows.join(loc, "location")
    fallback = F.when(F.col("environment") == "terrestrial", F.col("total_terrestrial_area")).otherwise(F.col("total_marine_area")).cast("double")
    own = F.col("total_area").cast("double")
    rows = rows.withColumns({"_total": F.when(F.coalesce(own, F.lit(0.0)) == 0, F.coalesce(fallback, F.lit(0.0))).otherwise(own), "_protected": F.coalesce(F.col(protected).cast("double"), F.lit(0.0))})
    keys = ["year", "environment", *([sub] if sub else [])]
    out = rows.groupBy(*keys).agg(
        F.sum("_total").alias("total_area"),
        F.sum("_protected").alias("protected_area"),
        F.array_sort(F.collect_set("location")).alias("locations"),
        F.coalesce(F.bool_or("has_shared_marine_area"), F.lit(False)).alias("has_shared_marine_area"),
        F.max("updated_at").alias("updated_at"),
    )
    return out.withColumn("coverage", percent("protected_area", F.nullif("total_area", F.lit(0.0))))


def named_stats(tables: Mapping[str, tuple[DataFrame, str | None]], wanted: str, locations: DataFrame, codes: str | None = None) -> dict[str, DataFrame]:
    """Several statistics in one call. ``tables``: name -> (rows, sub category); ``wanted`` and ``codes``:
    comma lists, in which unknown statistics are ignored."""
    names = [w.strip() for w in wanted.split(",")]
    chosen = [c for c in (codes or "").split(",") if c.strip()] or None
    return {n: aggregated_stats(tables[n][0], locations, chosen, sub=tables[n][1]) for n in names if n in tables}


def missing(requested: Column, found: Column) -> Column:
    """Requested codes that the answer lacks, sorted."""
    return F.array_sort(F.array_except(requested, found))


def what_if(coverage: DataFrame, drawn: DataFrame) -> DataFrame:
    """Existing plus drawn area by location; the drawn part counts at most what is still unprotected.

    ``coverage``: (location, total_area, protected_area); ``drawn``: (location, area).
    """
    extra = F.least("area", F.greatest(F.col("total_area") - F.col("protected_area"), F.lit(0.0)))
    rows = coverage.join(drawn, "location").withColumn("extra", extra)
    return rows.select(
        "location",
        percent("protected_area", "total_area").alias("existing_percent"),
        percent("extra", "total_area").alias("drawn_percent"),
        percent(F.col("protected_area") + F.col("extra"), "total_area").alias("combined_percent"),
    )


def localized(df: DataFrame, names: DataFrame, key: str, locale: str, default: str = "en") -> DataFrame:
    """Adds ``name`` in a locale, else in the default one, else the code. ``names``: (code, locale, name)."""
    pick = names.where(F.col("locale").isin(locale, default)).groupBy("code").agg(F.max_by("name", (F.col("locale") == locale).cast("int")).alias("name"))
    return df.join(pick, F.col(key) == F.col("code"), "left").drop("code").withColumn("name", F.coalesce("name", key))


def display_name(df: DataFrame, names: DataFrame, overrides: Mapping[str, str] | None = None, code: str = "code") -> DataFrame:
    """A location's name: an override, its own, that of the plain code with a star for roll-ups, else the code."""
    plain = F.replace(F.col(code), F.lit("*"), F.lit(""))
    n = names.select(F.col("code").alias("_c"), F.col("name").alias("_n"))
    out = df.join(n, plain == F.col("_c"), "left").drop("_c")
    given = F.lit(None).cast("string")
    for k, v in (overrides or {}).items():
        given = F.when(F.col(code) == k, v).otherwise(given)
    shown = F.coalesce(given, F.concat("_n", F.when(F.endswith(F.col(code), F.lit("*")), "*").otherwise("")), F.col(code))
    return out.withColumn("display_name", shown).drop("_n")


def backfill_locale(rows: DataFrame, locale: str, source: str = "en", key: str = "document_id") -> DataFrame:
    """Copies of the source locale's rows for keys that lack ``locale``; running it again adds none."""
    have = rows.where(F.col("locale") == locale).select(key)
    return rows.where(F.col("locale") == source).join(have, key, "left_anti").withColumn("locale", F.lit(locale))


def nested_filter(df: DataFrame, source: str, keep) -> DataFrame:
    """Filters a list of structs and drops rows left without any."""
    return df.withColumn(source, F.filter(source, keep)).where(F.size(source) > 0)


def bounds_union(df: DataFrame, bounds: str = "bounds", keys: Sequence[str] = ()) -> DataFrame:
    b = F.col(bounds)
    return df.groupBy(*keys).agg(F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3])).alias(bounds))


def in_locale(name: str, locale: str | None = None, *, strict: bool = False) -> Column:
    """A name as it is sorted in a locale (of no locale: by the root rules); accents and case matter last, or
    with ``strict`` not at all."""
    base = f"{locale}" if locale else "UNICODE"
    return F.collate(F.col(name), f"{base}_CI_AI" if strict else base)


def by_name(df: DataFrame, name: str = "name", locale: str | None = None, *, first: Sequence[str] = (), code: str = "code", keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``place`` (from 1) within the keys: codes of ``first`` in their order, then names as a locale
    sorts them, nulls last, ties by code."""
    leading = F.array_position(F.array(*[F.lit(c) for c in first]), F.col(code)) if first else F.lit(0)
    order = [F.when(leading > 0, leading).otherwise(len(first) + 1), in_locale(name, locale).asc_nulls_last(), F.col(code)]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ordered_like(df: DataFrame, source: str, order: Sequence[str]) -> DataFrame:
    """Rows in the order of a given list; those not in it come first, as for an index of -1."""
    return df.orderBy(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(source)), source)
