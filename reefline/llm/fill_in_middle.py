"""Fill-in-the-middle as a parallel automaton scan.

One automaton finds where lines begin and whether a text holds a sentinel. Texts are cut into chunks; each
chunk gives its function (for every state it may be entered in, the state after it and the lines that begin
in it). A text of one chunk is settled where it is read. The chunks of longer ones are dealt out over the
cluster, their functions composed in a tree of groups of ``FAN``; the two cuts are then looked for down that
tree, which gives the chunk, the state it is entered in and the line within it, so no task ever goes through
a giant text from its beginning. Texts aren't shuffled but for those chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.llm.automaton import Automaton, line_automaton
from reefline.llm.common import kept, workspace, written

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a chunk, and functions composed in a group.
CHUNK = 1 << 14
FAN = 64
#: Bytes of chunks or outputs handed on at once.
SLICE = 1 << 22

Batches = Iterable[pa.RecordBatch]


def draws(identifier: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first digits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def formed(data: bytes, n: int, found: bool, cuts: tuple[int, int], h3: int, h4: int, rate: int, spm: int, sentinels: tuple[str, ...]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text cut after two bytes."""
    if not data or found or h3 % 100 >= rate:
        return n, "plain", None, None, data
    a, b = cuts
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = (x.encode() for x in sentinels)
    parts, form = ((s, suffix, p, prefix, m, middle), "spm") if h4 % 100 < spm else ((p, prefix, s, suffix, m, middle), "psm")
    raw = np.frombuffer(data, np.uint8)
    return n, form, chars(raw[:a]), chars(raw[a:b]), b"".join(parts)


def ranks(h1: int, h2: int, n: int) -> tuple[int, int]:
    """Lines before the first and before the second cut."""
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b


def _batches(rows: Iterable[tuple], ids: Iterable, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        own, n, form, prefix, middle, output = zip(*held, strict=True)
        columns = [pa.array(own, id_type), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    for i, row in zip(ids, rows, strict=True):
        held.append((i, *row))
        size += len(row[-1])
        if size >= SLICE:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def of_one_chunk(machine: Automaton, rate: int, spm: int, sentinels: tuple[str, ...]):
    """Texts of one chunk: its function, entered in the first state, is that of the text."""

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        def row(data: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
            raw = np.frombuffer(data, np.uint8)
            levels = machine.levels(raw)
            after, count = levels[-1]
            n = int(count[0, 0])
            cuts = [machine.place(raw, levels, 0, r) if r < n else len(data) for r in ranks(h1, h2, n)]
            return formed(data, n, bool(machine.accepts[after[0, 0]]), (cuts[0], cuts[1]), h3, h4, rate, spm, sentinels)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(1, 6)]
            yield from _batches((row(*r) for r in zip(*columns, strict=True)), batch.column(0).to_pylist(), batch.schema.field(0).type)

    return scan


def chunked(chunk: int):
    """(key, at, data): the chunks of texts."""

    def split(batches: Batches) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "at", "data"])

        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = data.as_buffer()
                step = max(1, SLICE // chunk)
                for first in range(0, -(-len(text) // chunk), step):
                    at = range(first, min(first + step, -(-len(text) // chunk)))
                    yield batch([(key, k, text[k * chunk : (k + 1) * chunk].to_pybytes()) for k in at])

    return split


def functions(machine: Automaton):
    """(key, at, after, count) of chunks."""

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops = [machine.levels(np.frombuffer(x, np.uint8))[-1] for x in b.column(2).to_pylist()]
            after = pa.array([t[0][0].tolist() for t in tops], pa.list_(pa.int32()))
            count = pa.array([t[1][0].tolist() for t in tops], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), after, count], ["key", "at", "after", "count"])

    return scan


def composed(states: int) -> Column:
    """The function of ``parts``, which are in order."""
    none = f"struct(sequence(0, {states - 1}) AS after, array_repeat(0L, {states}) AS count)"
    return F.expr(
        f"aggregate(parts, {none}, (a, p) -> struct(transform(a.after, s -> p.after[s]) AS after, transform(a.count, (c, i) -> c + p.count[a.after[i]]) AS count))"
    )


def descended() -> Column:
    """The part in which event ``rank`` happens, entering the first one in ``state``."""
    return F.expr(
        "aggregate(parts, struct(-1L AS at, rank, state, false AS there), (a, p) -> if(a.there, a, if(a.rank < p.count[a.state], "
        "struct(p.at AS at, a.rank AS rank, a.state AS state, true AS there), struct(a.at AS at, a.rank - p.count[a.state] AS rank, p.after[a.state] AS state, false AS there))))"
    )


def cuts_of(texts: DataFrame, machine: Automaton, chunk: int, fan: int) -> DataFrame:
    """(key, n, last, cuts): of each of the written ``texts`` (key, text, h1, h2) its lines, its last state and
    for the cuts before its end the number of the cut, the chunk, and state and line there."""
    chunks = texts.select("key", F.col("text").cast("binary")).mapInArrow(chunked(chunk), "key long, at long, data binary")
    level = written(chunks.repartition("key", "at").mapInArrow(functions(machine), "key long, at long, after array<int>, count array<long>"), "chunk-functions")
    groups = []
    while True:
        parts = F.array_sort(F.collect_list(F.struct("at", "after", "count"))).alias("parts")
        groups.append(written(level.groupBy("key", F.floor(F.col("at") / fan).cast("long").alias("group")).agg(parts), "chunk-groups"))
        level = groups[-1].select("key", F.col("group").alias("at"), composed(machine.states).alias("f")).select("key", "at", "f.after", "f.count")
        if not groups[-1].agg(F.max("group")).first()[0]:
            break
    whole = level.select("key", F.col("count")[0].alias("n"), F.col("after")[0].alias("last"))
    drawn = written(texts.select("key", "h1", "h2").join(whole, "key").withColumn("u", F.array_sort(F.array(F.expr("h1 % (n + 1)"), F.expr("h2 % (n + 1)")))), "cut-lines")
    path = drawn.select("key", F.posexplode("u").alias("cut", "rank"), "n").where("rank < n").select("key", "cut", "rank", F.lit(0).alias("state"), F.lit(0).cast("long").alias("group"))
    for g in reversed(groups):
        found = path.join(g, ["key", "group"]).select("key", "cut", descended().alias("d"))
        path = found.select("key", "cut", "d.rank", "d.state", F.col("d.at").alias("group"))
    cuts = path.groupBy("key").agg(F.collect_list(F.struct("cut", F.col("group").alias("at"), "state", "rank")).alias("cuts"))
    return drawn.select("key", "n", "last").join(cuts, "key", "left")


def of_chunks(machine: Automaton, chunk: int, rate: int, spm: int, sentinels: tuple[str, ...]):
    """Texts whose cuts are known by chunk: only those chunks are looked at."""

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        def row(data: bytes, h3: int, h4: int, n: int, last: int, cuts: list[dict] | None) -> tuple:
            ends = [len(data)] * 2
            for c in cuts or []:
                raw = np.frombuffer(data[c["at"] * chunk : (c["at"] + 1) * chunk], np.uint8)
                ends[c["cut"]] = c["at"] * chunk + machine.place(raw, machine.levels(raw), c["state"], c["rank"])
            return formed(data, n, bool(machine.accepts[last]), (ends[0], ends[1]), h3, h4, rate, spm, sentinels)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(1, 7)]
            yield from _batches((row(*r) for r in zip(*columns, strict=True)), batch.column(0).to_pylist(), batch.schema.field(0).type)

    return scan


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    seed: str = "7",
    rate: int = 100,
    spm: int = 50,
    sentinels: tuple[str, str, str] = SENTINELS,
    chunk: int = CHUNK,
    fan: int = FAN,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): each text cut at two line ends drawn from its id.

    ``rate`` percent of the texts are transformed, ``spm`` percent of those with the suffix first. A text that
    is empty (or null, which counts as empty) or holds a sentinel stays as it is: form plain, and null for the
    counts of characters. n counts the lines of every text. Rows that repeat an id draw the same numbers; a
    null id draws those of an empty one. Other columns are ignored; an empty table gives no rows.
    """
    if len(set(sentinels)) < 3 or any("\n" in s for s in sentinels):
        raise ValueError("three different sentinels without line ends")
    machine = line_automaton(sentinels)
    id_type = docs.schema[id_col].dataType.simpleString()
    out = f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    h = [c.alias(f"h{k + 1}") for k, c in enumerate(draws(F.col(id_col), seed))]
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *h)
    is_long = F.octet_length("text") > chunk
    short = source.where(~is_long).withColumn("text", F.col("text").cast("binary")).mapInArrow(of_one_chunk(machine, rate, spm, sentinels), out)
    with workspace(docs.sparkSession, "fill-in-middle"):
        long = written(source.where(is_long).withColumn("key", F.monotonically_increasing_id()), "long-texts")
        if not long.isEmpty():
            cuts = written(cuts_of(long, machine, chunk, fan), "cuts")
            rows = long.join(cuts, "key").select("id", F.col("text").cast("binary"), "h3", "h4", "n", "last", "cuts")
            short = short.union(kept(rows.mapInArrow(of_chunks(machine, chunk, rate, spm, sentinels), out), "long-forms"))
    return short.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text an output was made of."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, len(first) + 1, 2**31 - 1)
        return F.substring_index(rest, second, 1), F.substring_index(F.substring_index(rest, second, -1), m, 1), F.substring_index(rest, m, -1)

    a, b, c = parts(p, s)
    d, e, f = parts(s, p)
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(e, f, d)).otherwise(output)
