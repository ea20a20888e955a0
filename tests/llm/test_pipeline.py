import corpus_pipeline as P
from llm_fixtures import docs_of, prose

from reefline.llm import packing
from reefline.llm.common import small_table
from reefline.llm.queries import QUERIES, SQL


def test_stages_take_effect(spark):
    base = [prose(k, 60) for k in range(8)]
    texts = [*base, base[1], base[2].upper(), base[3] + " tail", None, "1234 --", base[5]]
    langs = {i: "en" for i in range(8)}
    docs = docs_of(spark, texts, langs).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(docs.where("doc_id = 7"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = P.identified(spark, docs, "")
    assert one.columns == docs.columns and ids(one) == sorted([*range(11), 13, 7])
    assert {r.lang for r in one.collect()} == {"en"}
    two = P.deduplicated(spark, one, "")
    assert two.columns == docs.columns and ids(two) == [0, 3, 4, 6, 7, 8, 9, 10, 13]
    three = P.near_deduplicated(spark, two, "")
    assert three.columns == docs.columns and ids(three) == [0, 3, 4, 6, 7, 8, 9, 13]
    four = P.mixed(spark, three, "")
    assert four.columns == docs.columns and set(ids(four)) <= set(ids(three))
    five = P.packed(spark, four, "")
    assert sorted({r.doc_id for r in five.collect()}) == ids(four)
    for _, stage in P.STAGES:
        stage(spark, docs.limit(0), "").count()


def test_language_stage_leaves_no_python_to_the_caller(spark, capsys):
    """What the caller writes has no Python step, whose batches would hold whole texts by the session's 10,000 rows."""
    docs = docs_of(spark, [prose(k, 60) for k in range(8)], {i: "en" for i in range(6)})
    P.identified(spark, docs, "").explain()
    assert "MapInArrow" not in capsys.readouterr().out


def test_rows_without_a_label_get_one(spark):
    german = "das haus steht dort wo die alte straße sich zum wasser wendet und menschen denken über nichts als wetter"
    texts = [*(prose(k, 60) for k in range(6)), *[german] * 4, prose(9, 60), german, None, "12 --", None, german]
    docs = docs_of(spark, texts, {i: "de" if 6 <= i < 10 else "en" for i in range(10)})
    docs = docs.unionByName(docs.where("doc_id in (10, 11)")).unionByName(docs.where("doc_id in (11, 15)").selectExpr("cast(null as long) as doc_id", *docs.columns[1:]))
    docs = docs.unionByName(docs.where("doc_id = 0").replace("en", "xx", "lang").selectExpr("10L as doc_id", *docs.columns[1:]))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.lang) for r in P.identified(spark, docs, "").collect())
    some = [(i, texts[i], "de" if 6 <= i < 10 else "en") for i in range(10)]
    assert got == sorted([*some, *[(10, texts[10], "en")] * 2, (10, texts[0], "xx"), *[(11, german, "de")] * 2, (15, german, "de"), *[(-1, german, "de")] * 2])


def test_few_rows_start_no_python_workers(spark, capsys):
    small_table(spark, [("a", 1.5, None), ("b", None, None)], "`x y` string, w double, n long").explain()
    packing.pack(spark.createDataFrame([(1, 0, 5)], "doc_id long, piece int, length long").coalesce(1), 8).explain()
    assert capsys.readouterr().out.count("ExistingRDD") == 2  # the pieces, read twice
    rows = [("a", 1.5, None), ("b", None, 7)]
    assert [tuple(r) for r in small_table(spark, rows, "`x y` string, w double, n long").collect()] == rows
    empty = small_table(spark, [], "`x y` string, w double, n long")
    assert empty.columns == ["x y", "w", "n"] and empty.count() == 0


def test_register():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(SQL) <= set(QUERIES)
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "packing"]
