"""Requests of the public read API, compiled to one plan.

A catalogue says which collections there are, which fields each has and how they are related. A request
(fields, populate, filters, sort, pagination, locale) is checked against it and becomes a plan: filters through
to-one relations are joins, filters through to-many ones are semi joins on the distinct keys that match, made
before the page is cut; relations are read for the rows of the page only, from the innermost out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.operators.read_api import condition, page, paging, sort_spec

#: Rows on a page where a request says nothing, and at most.
PAGE, MOST = 25, 100_000
_LOGIC = ("$and", "$or", "$not")


@dataclass(frozen=True)
class Link:
    """A relation to a collection: ``key`` of the reader equals ``other_key`` of its rows. With ``bridge``
    (rows, column of the reader, column of the other), the relation goes through a table of pairs."""

    to: str
    key: str
    other_key: str
    many: bool = False
    bridge: tuple[DataFrame, str, str] | None = None


@dataclass(frozen=True)
class Collection:
    """``rows`` with a unique column ``id``; ``fields`` are shown, other columns only serve relations.
    ``names``: (document, locale, <field>...) for fields that are translated."""

    rows: DataFrame
    id: str
    fields: Sequence[str]
    links: Mapping[str, Link] = field(default_factory=dict)
    names: DataFrame | None = None


def parsed(text: str) -> dict:
    """A query string such as ``filters[a][$eq]=1&populate[b][fields][0]=c`` as nested dicts and lists."""
    from urllib.parse import unquote_plus

    tree: dict = {}
    for pair in filter(None, text.lstrip("?").split("&")):
        name, _, value = pair.partition("=")
        path = [p for p in re.split(r"[\[\]]+", unquote_plus(name)) if p] or [""]
        node = tree
        for p in path[:-1]:
            node = node.setdefault(p, {})
        node[path[-1]] = unquote_plus(value)

    def lists(node):
        if not isinstance(node, dict):
            return node
        if node and all(k.isdigit() for k in node):
            return [lists(node[k]) for k in sorted(node, key=int)]
        return {k: lists(v) for k, v in node.items()}

    return lists(tree)


def several(value) -> list:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


def commas(request: Mapping) -> dict:
    """The older mode, in which populate, fields and sort may be comma lists."""
    split = lambda v: [x.strip() for x in v.split(",")] if isinstance(v, str) and "," in v else v
    return {k: split(v) if k in ("populate", "fields", "sort") else v for k, v in request.items()}


class Catalogue:
    """Collections by name, and requests to them."""

    def __init__(self, collections: Mapping[str, Collection], locale: str = "en"):
        self.collections, self.locale = collections, locale

    def _collection(self, name: str) -> Collection:
        if name not in self.collections:
            raise ValueError(f"there is no collection {name}")
        return self.collections[name]

    def _link(self, name: str, relation: str) -> Link:
        links = self._collection(name).links
        if relation not in links:
            raise ValueError(f"{name} has no relation {relation}")
        return links[relation]

    def rows(self, name: str, locale: str | None = None) -> DataFrame:
        """A collection's rows; translated fields in a locale, else in the default one, else as they are."""
        c = self._collection(name)
        if c.names is None:
            return c.rows
        locale = locale or self.locale
        translated = [f for f in c.names.columns if f not in ("document", "locale")]
        rank = (F.col("locale") == locale).cast("int")
        best = c.names.where(F.col("locale").isin(locale, self.locale)).groupBy(F.col("document").alias("_document"))
        best = best.agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f"_name_{f}") for f in translated])
        joined = c.rows.join(best, F.col(c.id) == F.col("_document"), "left")
        return joined.select(*[F.coalesce(f"_name_{f}", f).alias(f) if f in translated else F.col(f) for f in c.rows.columns])

    # Filters.

    def _keys(self, name: str, spec: Mapping, locale: str | None) -> DataFrame:
        """(id): the rows of a collection that a filter accepts."""
        c = self._collection(name)
        marked, keep = self._marked(self.rows(name, locale), name, spec, locale)
        return marked.where(F.coalesce(keep, F.lit(False))).select(F.col(c.id).alias("_id"))

    def _marked(self, df: DataFrame, name: str, spec: Mapping, locale: str | None) -> tuple[DataFrame, Column]:
        """The rows with a flag for each relation that is filtered, and the condition on them."""
        c, parts = self._collection(name), []
        for k, v in spec.items():
            if k in ("$and", "$or"):
                inner = []
                for x in v:
                    df, keep = self._marked(df, name, x, locale)
                    inner.append(F.coalesce(keep, F.lit(False)))
                parts.append(reduce(lambda a, b: a & b if k == "$and" else a | b, inner, F.lit(k == "$and")))
            elif k == "$not":
                df, keep = self._marked(df, name, v, locale)
                parts.append(~F.coalesce(keep, F.lit(False)))
            elif k in c.links:
                flag = f"_has{sum(x.startswith('_has') for x in df.columns)}"
                owners = self._owners(name, k, self._keys(c.links[k].to, v, locale)).select(F.col("_owner"), F.lit(True).alias(flag))
                df = df.join(owners, F.col(c.links[k].key) == F.col("_owner"), "left").drop("_owner")
                parts.append(F.coalesce(F.col(flag), F.lit(False)))
            elif k in c.fields or k == c.id:
                parts.append(condition({k: v}))
            else:
                raise ValueError(f"{name} has no field {k}")
        return df, reduce(lambda a, b: a & b, parts, F.lit(True))

    def _owners(self, name: str, relation: str, keys: DataFrame) -> DataFrame:
        """(_owner): distinct key values of a collection's rows whose relation has one of the ids."""
        link = self._link(name, relation)
        other = self._collection(link.to)
        if link.bridge is None:
            matched = other.rows.join(keys, F.col(other.id) == F.col("_id"), "left_semi").select(F.col(link.other_key).alias("_owner"))
        else:
            pairs, mine, theirs = link.bridge
            matched = other.rows.join(keys, F.col(other.id) == F.col("_id"), "left_semi").select(F.col(link.other_key).alias("_there"))
            matched = pairs.join(matched, F.col(theirs) == F.col("_there"), "left_semi").select(F.col(mine).alias("_owner"))
        return matched.where("_owner is not null").distinct()

    def filtered(self, name: str, spec: Mapping | None, locale: str | None = None) -> DataFrame:
        rows = self.rows(name, locale)
        if not spec:
            return rows
        marked, keep = self._marked(rows, name, spec, locale)
        return marked.where(F.coalesce(keep, F.lit(False))).select(*rows.columns)

    # Relations.

    def _shown(self, name: str, fields) -> list[str]:
        c, wanted = self._collection(name), several(fields)
        if not wanted or "*" in wanted:
            return list(c.fields)
        unknown = [f for f in wanted if f not in c.fields]
        if unknown:
            raise ValueError(f"{name} has no field {unknown[0]}")
        return [c.id, *[f for f in wanted if f != c.id]]

    def _wanted(self, name: str, populate) -> dict[str, Mapping]:
        """Relation -> request, of ``*``, a name, a list of names (with dots for deeper ones) or a mapping."""
        if not populate:
            return {}
        if populate == "*":
            return {k: {} for k in self._collection(name).links}
        if isinstance(populate, Mapping):
            return {k: {} if v in (True, "true", "*") else v for k, v in populate.items()}
        out: dict[str, dict] = {}
        for path in several(populate):
            if path == "*":
                out |= {k: {} for k in self._collection(name).links if k not in out}
                continue
            first, _, rest = path.partition(".")
            node = out.setdefault(first, {})
            if rest:
                node.setdefault("populate", []).append(rest)
        return out

    def _populated(self, df: DataFrame, name: str, populate, locale: str | None, depth: int = 0) -> tuple[DataFrame, list[str]]:
        """The rows with their relations, and the names of these. Each depth has helping columns of its own."""
        owner, mine_, there = f"_owner{depth}", f"_mine{depth}", f"_there{depth}"
        c, wanted = self._collection(name), self._wanted(name, populate)
        for relation, request in wanted.items():
            link = self._link(name, relation)
            other = self._collection(link.to)
            rows = self.filtered(link.to, request.get("filters"), locale)
            mine = df.select(F.col(link.key).alias(mine_)).where(F.col(mine_).isNotNull()).distinct()
            if link.bridge is None:
                rows = rows.withColumn(owner, F.col(link.other_key)).join(mine, F.col(owner) == F.col(mine_), "left_semi")
            else:
                pairs, a, b = link.bridge
                pairs = pairs.select(F.col(a).alias(owner), F.col(b).alias(there)).distinct().join(mine, F.col(owner) == F.col(mine_), "left_semi")
                rows = rows.join(pairs, F.col(link.other_key) == F.col(there)).drop(there)
            rows, inner = self._populated(rows, link.to, request.get("populate"), locale, depth + 1)
            shown = self._shown(link.to, request.get("fields"))
            one = F.struct(*shown, *inner)
            if link.many:
                order = [(F.col(p), up) for p, up in sort_spec(request.get("sort"))]
                listed = rows.groupBy(owner).agg(F.collect_list(F.struct(*[k.alias(f"_s{i}") for i, (k, _) in enumerate(order)], F.col(other.id).alias("_sid"), one.alias("_one"))).alias("_all"))
                listed = listed.select(owner, F.transform(F.array_sort("_all", _by([up for _, up in order])), lambda x: x["_one"]).alias(relation))
            else:
                listed = rows.groupBy(owner).agg(F.min_by(one, F.col(other.id)).alias(relation))
            own, kind = f"_in{depth}_{relation}", listed.schema[relation].dataType
            df = df.join(listed.withColumnRenamed(relation, own), F.col(link.key) == F.col(owner), "left").drop(owner)
            if link.many:
                df = df.withColumn(own, F.coalesce(own, F.from_json(F.lit("[]"), kind)))
        # A relation may have the name of its key.
        return df.drop(*wanted).withColumnsRenamed({f"_in{depth}_{r}": r for r in wanted}), list(wanted)

    # Requests.

    def _sorted(self, df: DataFrame, name: str, sort, locale: str | None) -> tuple[DataFrame, list[Column]]:
        """The rows with columns to sort by, and the order: by fields or fields of to-one relations, nulls
        last both ways, then by id."""
        c, order = self._collection(name), []
        for i, (path, up) in enumerate(sort_spec(sort)):
            relation, _, last = path.rpartition(".")
            key = f"_sort{i}"
            if relation:
                link = self._link(name, relation)
                if link.many or link.bridge is not None or "." in relation:
                    raise ValueError(f"{path} isn't one value")
                self._shown(link.to, last)
                other = self.rows(link.to, locale).groupBy(F.col(link.other_key).alias("_k")).agg(F.min(last).alias(key))
                df = df.join(other, F.col(link.key) == F.col("_k"), "left").drop("_k")
            elif path not in c.fields and path != c.id:
                raise ValueError(f"{name} has no field {path}")
            else:
                df = df.withColumn(key, F.col(path))
            order.append(F.col(key).asc_nulls_last() if up else F.col(key).desc_nulls_last())
        return df, [*order, F.col(c.id).asc()]

    def read(self, name: str, request: Mapping | str | None = None, *, v4: bool = False) -> tuple[DataFrame, DataFrame]:
        """(data, meta) of a request. ``v4``: comma lists are allowed. Unknown fields, relations and operators
        are errors, as they would otherwise widen what is read."""
        request = parsed(request) if isinstance(request, str) else dict(request or {})
        request = commas(request) if v4 else request
        locale = request.get("locale")
        rows = self.filtered(name, request.get("filters"), locale)
        asked = {k: int(v) for k, v in (request.get("pagination") or {}).items()}
        if asked.get("page", 1) < 1 or asked.get("pageSize", 1) < 1 or asked.get("start", 0) < 0:
            raise ValueError("pages begin with 1")
        size = min(asked.get("pageSize", PAGE), MOST)
        keyed, order = self._sorted(rows, name, request.get("sort"), locale)
        cut = page(keyed.orderBy(*order), limit=asked.get("limit"), start=asked.get("start"), page=asked.get("page"), page_size=size, default=PAGE, most=MOST)
        data, inner = self._populated(cut, name, request.get("populate"), locale)
        return data.orderBy(*order).select(*self._shown(name, request.get("fields")), *inner), paging(rows, asked.get("page", 1), size)

    def find(self, name: str, identifier, request: Mapping | str | None = None) -> DataFrame:
        """One record by its id, with fields and relations as asked; no row if there is none."""
        request = parsed(request) if isinstance(request, str) else dict(request or {})
        c = self._collection(name)
        data, inner = self._populated(self.rows(name, request.get("locale")).where(F.col(c.id) == F.lit(identifier)), name, request.get("populate"), request.get("locale"))
        return data.select(*self._shown(name, request.get("fields")), *inner)


def _by(ascending: Sequence[bool]) -> Callable[[Column, Column], Column]:
    """Compares structs by _s0, _s1 ... and then by _sid, nulls last."""

    def compare(a: Column, b: Column) -> Column:
        out = F.when(a["_sid"] < b["_sid"], -1).when(a["_sid"] > b["_sid"], 1).otherwise(0)
        for i, up in reversed(list(enumerate(ascending))):
            x, y = a[f"_s{i}"], b[f"_s{i}"]
            less, more = (-1, 1) if up else (1, -1)
            differ = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), 1).when(y.isNull(), -1).when(x < y, less).when(x > y, more).otherwise(0)
            out = F.when(differ != 0, differ).otherwise(out)
        return out

    return compare
