"""Text parsing shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from reefline.functions.numbers import blank_to_null, col


def year_of(c: Column | str) -> Column:
    """The year of text like ``2010-05-01``; null for blank or unreadable text."""
    return F.split(blank_to_null(c), "-")[0].try_cast("int")


def split_codes(c: Column | str, separators: str = "[;:,]") -> Column:
    """Trimmed, non-empty codes of a separated list."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), separators), F.trim), lambda x: x != "")


def float_list(c: Column | str) -> Column:
    """``(1, 2.5)`` or ``[1, 2.5]`` as an array of doubles; null if it isn't one."""
    parsed = F.from_json(F.translate(col(c), "()", "[]"), "array<double>")
    return F.when(~F.exists(parsed, lambda x: x.isNull()), parsed)


def python_dict(c: Column | str, schema: str) -> Column:
    """Text of a Python dict literal as a struct."""
    x = col(c)
    for python, json in ((r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bnan\b", "null")):
        x = F.regexp_replace(x, python, json)
    return F.from_json(x, schema, {"allowSingleQuotes": "true"})


def lookup(c: Column | str, values: Mapping, default: Column | None = None) -> Column:
    """A small constant mapping; null (or ``default``) where there is no entry."""
    key = col(c)
    if not values:
        return default if default is not None else F.lit(None)
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, default)


def identifier(*columns: Column | str) -> Column:
    """Key text: the columns joined by ``_``; whole numbers without decimals, ``<NA>`` for missing ones."""

    def part(c: Column | str) -> Column:
        text = col(c).cast("string")
        large = F.when(text.rlike(r"^-?\d(\.\d+)?E\d+$"), text.try_cast("decimal(38,0)").cast("string"))
        return F.coalesce(large, F.regexp_replace(text, r"\.0$", ""), F.lit("<NA>"))

    return F.concat_ws("_", *[part(c) for c in columns])


def lists_differ(a: Column | str, b: Column | str, *, ordered: bool) -> Column:
    """Whether two arrays differ. Ordered: also if either isn't there. Unordered: nulls don't count."""
    x, y = col(a), col(b)
    if ordered:
        return F.coalesce(x != y, F.lit(True))
    tidy = lambda c: F.array_sort(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: v.isNotNull()))
    return tidy(x.cast("array<string>")) != tidy(y.cast("array<string>"))
