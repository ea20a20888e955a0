"""Secret scans with linking of multipart credentials.

A credential has parts: who (an access identifier), the secret itself, and where it is used (an endpoint).
Strong finds (assigned values, access keys, long hex runs) are reported wherever they stand. Weak candidates,
such as a user name, a short password or an address, are common in clean text and are reported only where
complementary parts stand close by in the same scope (lines without a blank one between them): a name with a
secret, a secret with a name, an endpoint with both.

Tasks find the candidates; whether complementary parts co-occur is an interval join of the weak ones with all
parts, as an equi-join on the stretches of a text that both touch. A stretch holds a bounded number of
candidates, so no group grows with a document. Texts take no part in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import kept, workspace, written

WHO, SECRET, WHERE = 1, 2, 4
#: What lies between a name and its value.
ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
SCOPE_END = r"\n[ \t\r]*\n"
#: Code points between two parts of a credential at most, and those of a stretch of text.
REACH = 200
STRETCH = 512


@dataclass(frozen=True)
class Kind:
    """Candidates of a kind: a pattern for texts whose A-Z are lower case (unless ``as_is``), the group that
    holds the value and its least length; where none of ``cues`` occurs there is no match. ``needs``: roles
    that have to stand close by, 0 for strong kinds."""

    name: str
    role: int
    pattern: str
    group: int
    least: int
    cues: tuple[str, ...] = ()
    as_is: bool = False
    needs: int = 0

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern)


KINDS = (
    Kind("assign", SECRET, rf"(password|passwd|secret|token|api_?key){ASSIGNED}([a-z0-9+/_.=-]+)", 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    # From 18 and 16 characters on, the same finds as of runs of any length that are dropped where they are shorter.
    Kind("access", WHO, r"AKIA[A-Z0-9]{14,}", 0, 18, ("AKIA",), as_is=True),
    Kind("hex", SECRET, r"[0-9a-f]{16,}", 0, 16, as_is=True),
    Kind("identifier", WHO, rf"(user(?:_?name)?|login|account|client_?id|key_?id){ASSIGNED}([a-z0-9@._+-]+)", 2, 3, ("user", "login", "account", "client", "keyid", "key_id"), needs=SECRET),
    Kind("secret", SECRET, rf"(password|passwd|passphrase|passwort|pass|pwd|secret|token|api_?key){ASSIGNED}([a-z0-9+/_.=!@#$%&*-]+)", 2, 6, ("pass", "pwd", "secret", "token", "apikey", "api_key"), needs=WHO),
    Kind("endpoint", WHERE, rf"([a-z][a-z0-9+.-]{{1,15}}://|(?:host(?:_?name)?|server|endpoint|region){ASSIGNED})([a-z0-9._:/@-]+)", 2, 4, ("://", "host", "server", "endpoint", "region"), needs=WHO | SECRET),
)
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())]))
_SPANS_SQL = "array<struct<kind:int,start:bigint,end:bigint,scope:bigint>>"


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all kinds, for each leftmost and without overlaps."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes lower-case A-Z only
    out = []
    for k, kind in enumerate(KINDS):
        own = text if kind.as_is else low
        if not kind.cues or any(c in own for c in kind.cues):
            out += [(k, *m.span()) for m in kind.regex.finditer(own) if len(m[kind.group]) >= kind.least]
    return out


def found(text: str) -> tuple[list[dict], list[dict]]:
    """Strong and weak candidates with their scopes; weak ones that touch a strong one aren't any."""
    strong, weak, at, ends = [], [], 0, None
    for start, k, end in sorted((s, k, e) for k, s, e in candidates(text)):
        if ends is None:
            ends = [m.end() for m in re.finditer(SCOPE_END, text)]
        while at < len(ends) and ends[at] <= start:
            at += 1
        (weak if KINDS[k].needs else strong).append({"kind": k, "start": start, "end": end, "scope": at})
    return strong, clear_of(strong, weak)


def clear_of(strong: list[dict], weak: list[dict]) -> list[dict]:
    """The weak spans that touch no strong one; both in order of their start."""
    out, upto, at = [], -1, 0
    for w in weak:
        while at < len(strong) and strong[at]["start"] < w["end"]:
            upto = max(upto, strong[at]["end"])
            at += 1
        if upto <= w["start"]:
            out.append(w)
    return out


def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, len(b), 1000):
            part = b.slice(k, 1000)
            spans = [found(t or "") for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array([s[i] for s in spans], _SPANS) for i in (0, 1)]], ["key", "id", "strong", "weak"])


def _role(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k.role) for k in KINDS]), kind + 1)


def _stretches(df: DataFrame, before: int, length: int) -> DataFrame:
    first = F.floor(F.greatest(F.col("start") - before, F.lit(0)) / length)
    return df.withColumn("stretch", F.explode(F.sequence(first, F.floor((F.col("end") + before) / length))))


def linked(rows: DataFrame, reach: int, stretch: int) -> DataFrame:
    """(key, more): the weak spans of a written table (key, strong, weak) whose complements are in reach."""
    span = lambda c: rows.select("key", F.explode(c).alias("x")).select("key", "x.*")
    weak = span("weak")
    parts = span("strong").union(weak).join(weak.select("key").distinct(), "key", "left_semi")
    there = _stretches(parts, 0, stretch).select("key", "scope", "stretch", F.col("start").alias("s"), F.col("end").alias("e"), _role(F.col("kind")).alias("role"))
    near = _stretches(weak, reach, stretch).join(there, ["key", "scope", "stretch"])
    needs = F.element_at(F.array(*[F.lit(k.needs) for k in KINDS]), F.col("kind") + 1)
    gap = F.greatest("start", "s") - F.least("end", "e")
    hits = near.where((needs.bitwiseAND(F.col("role")) != 0) & (gap <= reach)).groupBy("key", "kind", "start", "end").agg(F.bit_or("role").alias("roles"))
    return hits.where(needs.bitwiseAND(F.col("roles")) == needs).groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, reach: int = REACH, stretch: int = STRETCH) -> DataFrame:
    """(id, base, spans): the strong spans of each text, and those with the weak ones that are linked.

    A span is (start, kind, end) in code points, end exclusive; kind is a place in ``KINDS``; spans are in
    that order. A null text counts as empty: no spans. Rows are told apart whatever their ids, so rows that
    repeat an id, or have none, have their own spans and don't link with one another. Other columns are
    ignored; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with workspace(docs.sparkSession, "secrets"):
        rows = written(source.mapInArrow(scanned, f"key long, id {id_type}, strong {_SPANS_SQL}, weak {_SPANS_SQL}"), "candidates")
        more = written(linked(rows, reach, stretch), "linked")
        base = F.transform("strong", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
        out = rows.select("key", "id", base.alias("base")).join(more, "key", "left")
        spans = F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")))
        return kept(out.select(F.col("id").alias(id_col), "base", spans.alias("spans")), "secret-spans")


def shown(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = lambda x: F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"], x["end"])), ",")


def number(spans: Column, kind: str) -> Column:
    at = next(k for k, x in enumerate(KINDS) if x.name == kind)
    return F.size(F.filter(spans, lambda x: x["kind"] == at)).cast("long")
