from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reefline.llm import exact_dedup as E
from reefline.llm.common import UPPER, id_filter, maybe_in, without


def groups(texts):
    out = defaultdict(list)
    for i, t in enumerate(texts):
        out[(t or "").translate(str.maketrans(UPPER, UPPER.lower()))].append(i)
    return out


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_equals_brute_force(spark, docs, texts, keep, weak):
    digest = (lambda c: F.unhex(F.hex((F.length(c) % 3).cast("string")))) if weak else E.sha256
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(docs, keep=keep, digest=digest).collect()}
    want = {}
    for ids in groups(texts).values():
        k = max(ids) if keep == "largest" else min(ids)
        want |= {i: (k, len(ids), i == k) for i in ids}
    assert got == want


def test_null_and_repeated_ids_and_empty(spark, empty):
    assert E.exact_dedup(empty).count() == 0
    df = spark.createDataFrame([(1, "a"), (None, "A"), (1, "a"), (None, "q")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(df).collect()), key=str)
    assert rows == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)], key=str)


def test_only_ascii_letters_are_lowered(spark):
    df = spark.createDataFrame([(1, "ÉK"), (2, "éK"), (3, "Ék")], "doc_id long, text string")
    assert {r.group_size for r in E.exact_dedup(df).collect()} == {1}


def test_id_filter(spark):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "i")
    rows = spark.range(3000).select(F.col("id").alias("i"), F.lit("x").alias("__bucket"))
    kept = {r.i for r in maybe_in(rows, id_filter(ids, "i"), "i").collect()}
    assert kept >= set(range(0, 3000, 3)) and len(kept) < 1200
    left = without(rows, ids, i=F.col("i"))
    assert left.columns == rows.columns and {r.i for r in left.collect()} == {i for i in range(3000) if i % 3}
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, None), (2, "a")], "i int, t string")
    gone = spark.createDataFrame([(1, "a"), (None, None)], "i int, t string")
    assert sorted(map(str, (tuple(r) for r in without(pairs, gone, i=F.col("i"), t=F.col("t")).collect()))) == sorted(map(str, [(1, "b"), (None, "a"), (2, "a")]))


def runs_of(index):
    run = index.run()
    return sorted((bytes(r._digest), r._low, r._high, r._n) for r in run.rows.collect())


def test_batches_may_be_added(spark):
    """An index that gets its rows in several batches, with compactions between, equals one of all rows."""
    rows = spark.range(400).select(F.col("id").alias("_id"), F.unhex(F.md5((F.col("id") * F.col("id") % 97).cast("string"))).alias("_digest"))
    one = E.LsmIndex()
    one.add(rows)
    many = E.LsmIndex(memtables=2, fanout=3)
    for k in range(4):
        many.add(rows.where(F.col("_id") % 4 == k))
    assert [len(level) for level in many.levels] == [2, 2]  # eight runs, three to a compaction
    assert runs_of(one) == runs_of(many)
    assert sum(r[3] for r in runs_of(many)) == 400


def test_compaction_groups_only_what_filters_know(spark):
    log = lambda a, b: E.Run.flush(E.merged(spark.range(a, b).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("_digest"), F.col("id").alias("_low"), F.col("id").alias("_high"), F.lit(1).cast("long").alias("_n"))), "r")
    a, b = log(0, 1000), log(900, 2000)
    alone, shared = E.split([a, b])
    assert 200 <= shared.count() < 300 and alone.count() + shared.count() == 2100
    assert {r._low for r in shared.collect()} >= set(range(900, 1000))
    small = log(950, 960)  # filters of another size
    alone, shared = E.split([a, b, small])
    assert 210 <= shared.count() < 330 and alone.count() + shared.count() == 2110
    assert E.compact([a, b], "c").rows.where("_n > 1").count() == 100


def test_memtables_are_bounded_in_rows(spark):
    rows = spark.range(1000).select(F.col("id").alias("_id"), F.unhex(F.md5((F.col("id") % 700).cast("string"))).alias("_digest"))
    index = E.LsmIndex(memtables=2, fanout=100, rows=150)
    index.add(rows)
    sizes = [r.rows.agg(F.sum("_n")).first()[0] for r in index.levels[0]]
    assert len(sizes) == 7 and sum(sizes) == 1000 and max(sizes) < 250
    assert len(runs_of(index)) == 700
