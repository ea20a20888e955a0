"""Exact Jaccard self-join of documents on word shingles, by a token-group matrix.

1. A text becomes a set of shingle hashes. Documents with equal sets are one class; one row stands for it.
2. Similar classes form groups: classes that share a pair of min-hashes are compared with the most
   connected class among them, and those that do link are joined. Groups are cut by the size of their sets,
   so that members of one row of the matrix differ by less than the threshold allows.
3. The matrix stores each group's token union: a row for each token and group, with the range of its
   members' sizes. Of a set's tokens only the first ones in one corpus-wide order can decide (prefix
   filter): n - ceil(t n) + 1 where it is the larger set, n - ceil(2t/(1+t) n) + 1 where it is the smaller
   one. The order puts rare tokens first (counts of all documents in a sketch of fixed size), so passages
   that many documents share open few groups.
4. For each class and group the matrix counts the tokens of the class in the group's union. That bounds the
   overlap with any member: all shared tokens but those beyond the prefixes are counted. Only groups that
   can reach the threshold are opened.
5. The members of opened groups that share a prefix token with the class, from which on both have enough
   left to reach the overlap, are compared by parity bitmaps, and what passes for good.
6. Links join groups into components.

Compared for good means: both whole texts are read again and their sets intersected. Pairs within a group
are never listed: its members are linked already, and only components and set sizes are returned.

Hashes have 64 bits; a wrong decision needs a collision between the two sets that are compared.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import id_filter, kept, maybe_in, small_batches, workspace, written
from reefline.llm.graph import components
from reefline.llm.shingles import chunks, mix, shingle_sets

BANDS = 4
SKETCH_BITS = 22
_PART_BITS = 14
_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_overlap(n: int, t: Fraction) -> int:
    """ceil(t n): what two sets must share at least if the larger one has n tokens."""
    return -(-t.numerator * n // t.denominator)


def token_classes(docs: DataFrame, width: int) -> np.ndarray:
    """How frequent the tokens of each of 2^k buckets are: 0 up to three deviations above what chance
    gives a bucket, then one more for each doubling. There are 16 to 32 buckets for each document, up to
    2^22. Tasks send their counts compressed; sums are taken part by part."""
    bits = min(max(int(16 * docs.count()).bit_length(), 16), SKETCH_BITS)
    part = 1 << _PART_BITS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for texts in chunks((x.as_py() or "" for x in batch.column(0)), 1 << 21):
                buckets = np.concatenate([s for t in chunks(texts) for s in shingle_sets(t, width)]) >> np.uint64(64 - bits)
                np.add.at(seen, buckets.astype(np.int64), np.uint32(1))
        blobs = [zlib.compress(seen[k : k + part].tobytes(), 1) for k in range(0, len(seen), part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(blob), dtype=np.uint32).astype(np.uint64)
                sums[k] = sums[k] + counts if k in sums else counts
        data = [np.minimum(s, (1 << 32) - 1).astype(np.uint32).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], ["part", "counts"])

    parts = docs.select("text").mapInArrow(count, "part int, counts binary").repartition(1 << max(bits - _PART_BITS - 2, 0), "part")
    sums = np.zeros(1 << bits, dtype=np.float64)
    for r in parts.mapInArrow(add, "part int, counts binary").toLocalIterator():
        sums[r.part * part : (r.part + 1) * part] = np.frombuffer(r.counts, dtype=np.uint32)
    mean = max(float(np.median(sums)), 1.0)
    over = (sums - mean) / (3 * mean**0.5)
    return np.where(over > 1, 1 + np.floor(np.log2(np.maximum(over, 1))), 0).astype(np.uint8)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by hash, in about a bit for each token: the bits in which two bitmaps of
    one size differ are at most the tokens in which the sets do."""
    size = 1 << max(6, int(len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def differ_at_least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps in the rows of x and y differ, the larger ones folded."""
    while x.shape[1] > y.shape[1]:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    while y.shape[1] > x.shape[1]:
        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


PROFILE = "doc_id long, text_hash long, n_shingles long, n_rare long, class binary, bands array<long>, bitmap binary, prefix array<long>"


def profiles(docs: DataFrame, width: int, t: Fraction, frequent: np.ndarray) -> DataFrame:
    """For each document its set's size, class, min-hash bands, bitmap and first tokens."""
    shift = np.uint64(65 - len(frequent).bit_length())

    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for texts in chunks(x.as_py() or "" for x in batch.column(2)):
                for s in shingle_sets(texts, width):
                    n = len(s)
                    if not n:
                        rows.append((0, 0, None, None, None, None))
                        continue
                    key = np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64), (s * _SEEDS[0]).sum(dtype=np.uint64) ^ np.uint64(n)], dtype="<u8").tobytes()
                    least = np.array([(s * seed).min() for seed in _SEEDS])
                    bands = mix(least[::2] * _SEEDS[0] + least[1::2] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                    common = frequent[(s >> shift).astype(np.int64)]
                    order = np.argsort(common, kind="stable")
                    prefix = s[order[: n - least_overlap(n, t) + 1]].view(np.int64)
                    rows.append((n, int((common == 0).sum()), key, bands, bitmap(s), prefix))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "text_hash", "n_shingles", "n_rare", "class", "bands", "bitmap", "prefix"])

    return docs.mapInArrow(profile, PROFILE)


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, t: Fraction, repeated: bool) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold. Texts come from a scan of ``docs`` that
    an id filter of bounded size narrows to the rows that stand for the pairs' classes. ``repeated``: some
    rows repeat an id and a text."""
    pairs = pairs.select("a", "b")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "doc_id", "text_hash"), "rep"), "asked")
    texts = maybe_in(docs, id_filter(asked, "doc_id", "text_hash"), "doc_id", "text_hash").join(asked, ["doc_id", "text_hash"])
    texts = written(texts.groupBy("rep").agg(F.first("text").alias("text")), "asked-texts") if repeated else texts.select("rep", "text")
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            b = batch.column(1).to_pylist()
            links = np.zeros(len(b), dtype=bool)
            at = 0
            for texts in chunks(x.as_py() for x in batch.column(2)):
                for s in shingle_sets(texts, width):
                    if b[at] != last:
                        last, other = b[at], next(shingle_sets([batch.column(3)[at].as_py()], width))
                    both = len(s) + len(other) - len(np.union1d(s, other))
                    links[at] = t.denominator * both >= t.numerator * (len(s) + len(other) - both)
                    at += 1
            yield batch.select([0, 1]).filter(pa.array(links))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def near(pairs: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b, n_a, n_b, bitmap_a, bitmap_b) whose bitmaps leave a link possible."""

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("bitmap_a").to_pylist(), batch.column("bitmap_b").to_pylist()
            n = np.array(batch.column("n_a")) + np.array(batch.column("n_b"))
            apart = np.zeros(len(x), dtype=np.int64)
            of_sizes: dict[tuple[int, int], list[int]] = {}
            for i, sizes in enumerate(zip(map(len, x), map(len, y), strict=True)):
                of_sizes.setdefault(sizes, []).append(i)
            for at in of_sizes.values():
                apart[at] = differ_at_least(*(np.frombuffer(b"".join(z[i] for i in at), dtype=np.uint8).reshape(len(at), -1) for z in (x, y)))
            # J >= t with n tokens in both together: at most n (1 - t) / (1 + t) of them are in one set only
            keep = apart * (t.denominator + t.numerator) <= n * (t.denominator - t.numerator)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(sift, "a long, b long")


def ceil_of(share: Fraction, n: Column) -> Column:
    """ceil(share n) for whole numbers n >= 0."""
    return F.floor((F.lit(share.numerator) * n + (share.denominator - 1)) / share.denominator).cast("long")


def least_shared(t: Fraction, larger: Column, smaller: Column) -> Column:
    """How many tokens the prefixes of two sets of these sizes share at least if the sets reach ``t``."""
    both = t / (1 + t)
    return ceil_of(both, larger + smaller) - F.greatest(ceil_of(t, larger), ceil_of(2 * both, smaller)) + 1


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, threshold: str | Fraction = "0.8", with_text_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of the links with Jaccard similarity of at least
    ``threshold`` between sets of ``width``-word shingles; component_id is the smallest id in it.
    ``with_text_hash``: text_hash too, Spark's xxhash64 of the text, which tells rows of one id apart.

    A text with fewer words is one shingle; one that is null or has no word has none, links with nothing
    and is its own component. Equal texts link. Rows that repeat an id count as one document each: what one
    of them links with says nothing of the others. A row with a null id stays alone, with a null component.
    Other columns are ignored; an empty table gives no rows.
    """
    t = Fraction(threshold)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    with workspace(spark, "jaccard"), small_batches(spark):
        profile = written(profiles(docs, width, t, token_classes(docs, width)), "profiles")
        linked = profile.where("class is not null and doc_id is not null")
        # A class has a number of its own: its rows' ids may have other texts too.
        first = linked.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"))
        classes = written(first.select("class", "f.doc_id", "f.text_hash", F.monotonically_increasing_id().alias("rep")), "classes")
        repeated = not linked.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
        reps = written(linked.join(classes, ["class", "doc_id", "text_hash"]).dropDuplicates(["rep"]).drop("class"), "reps")

        # Groups of similar classes.
        # A band's pivot is the class that shares most bands with others, of those the one with the fewest
        # rare tokens: the text that copies were made from, if it is there, shares all and has none.
        banded = written(reps.select("rep", "doc_id", F.col("n_shingles").alias("n"), "n_rare", F.explode("bands").alias("band")), "bands")
        crowds = written(banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "crowds")
        shared_bands = written(banded.join(crowds, "band"), "shared-bands")
        scores = written(shared_bands.groupBy("rep").agg(F.sum("c").alias("score")), "scores")
        rank = F.struct(F.col("score"), (-F.col("n_rare")).alias("common"), (-F.col("doc_id")).alias("first"), F.col("rep"), F.col("n"))
        pivots = written(shared_bands.join(scores, "rep").groupBy("band").agg(F.max(rank).alias("p")).select("band", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n")), "pivots")
        banded = shared_bands.select("rep", "n", "band")
        fits = (t.numerator * F.greatest("n", "pivot_n") <= t.denominator * F.least("n", "pivot_n")) & (F.col("rep") != F.col("pivot"))
        near_pivot = banded.join(pivots, "band").where(fits).select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
        links = written(verified(written(near_pivot, "pairs"), reps, docs, width, t, repeated), "links")
        groups = components(links).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
        grouped = written(reps.select("rep", F.col("n_shingles").alias("n"), "prefix").join(groups, "rep", "left").select("rep", F.coalesce("grp", "rep").alias("grp"), "n", "prefix"), "grouped")

        # The matrix of tokens and groups; only tokens in two groups or more can open one.
        rows = grouped.select("rep", "grp", "n", F.posexplode("prefix").alias("pos", "token"))
        shared = written(rows.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token"), "shared-tokens")
        band = F.floor(F.log(F.col("n").cast("double")) / (math.log(1 / t) * (1 + 1e-9))).cast("int")  # sizes that can link are in one band or the next
        queries = written(maybe_in(rows, id_filter(shared, "token"), "token").join(shared, "token").withColumn("size_band", band), "query-tokens")
        union = written(queries.where(F.col("pos") <= F.col("n") - ceil_of(2 * t / (1 + t), F.col("n"))), "union-tokens")
        matrix = written(union.groupBy("token", "size_band", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest")), "matrix")

        # Which groups each class opens: the class is the larger set, or the two are of one size.
        least = F.greatest(F.col("lo"), ceil_of(t, F.col("n")))
        reach = (t.denominator + t.numerator) * F.least(F.col("n") - F.col("pos"), F.col("rest")) >= t.numerator * (F.col("n") + least)
        asking = queries.select("rep", F.col("grp").alias("own"), "n", "pos", "token", F.explode(F.array(F.col("size_band"), F.col("size_band") - 1)).alias("size_band"))
        met = asking.join(matrix, ["token", "size_band"]).where((F.col("own") != F.col("grp")) & (F.col("lo") <= F.col("n")) & (t.numerator * F.col("n") <= t.denominator * F.col("hi")))
        counted = met.withColumn("reach", reach).groupBy("rep", "own", "n", "grp", "size_band").agg(F.count("*").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("reach").alias("reach"))
        low, high = F.greatest(F.col("lo"), ceil_of(t, F.col("n"))), F.least(F.col("hi"), F.col("n"))
        bound = F.least(least_shared(t, F.col("n"), low), least_shared(t, F.col("n"), high)) - F.when(low < high, 1).otherwise(0)  # the least between is at an end, but for rounding
        opened = written(counted.where(F.col("reach") & (F.col("c") >= bound)).select("rep", "own", "grp", "size_band"), "open-groups")

        # Members of the opened groups.
        mine = opened.join(queries.select("rep", F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), "token"), "rep")
        theirs = union.select("grp", "size_band", "token", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
        larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("rep") > F.col("b")))
        size = t.numerator * F.col("n_a") <= t.denominator * F.col("n_b")
        ahead = (t.denominator + t.numerator) * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= t.numerator * (F.col("n_a") + F.col("n_b"))
        shared_by = mine.join(theirs, ["grp", "size_band", "token"]).where(larger & size & ahead)
        pairs = written(shared_by.groupBy(F.col("rep").alias("a"), "b", "n_a", "n_b").agg(F.first("own").alias("grp_a"), F.first("grp").alias("grp_b")), "open-pairs")
        facts_a, facts_b = (reps.select(F.col("rep").alias(s), F.col("bitmap").alias(f"bitmap_{s}")) for s in "ab")
        sifted = written(near(pairs.join(facts_a, "a").join(facts_b, "b").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b"), t), "near-pairs")
        more = verified(sifted, reps, docs, width, t, repeated).join(pairs, ["a", "b"]).select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b"))
        merged = components(more).select(F.col("node").alias("grp"), F.col("component").alias("top"))

        part = written(grouped.select("rep", "grp").join(merged, "grp", "left").select("rep", F.coalesce("top", "grp").alias("part")).join(classes, "rep"), "class-parts")
        smallest = written(part.groupBy("part").agg(F.min("doc_id").alias("component_id")), "smallest-ids")
        found = written(part.join(smallest, "part").select("class", "component_id"), "class-components")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
        out = profile.select("doc_id", "text_hash", "n_shingles", "class").join(found, "class", "left")
        return kept(out.select(F.col("doc_id").alias(id_col), "n_shingles", component, *["text_hash"] * with_text_hash), "jaccard-result")
