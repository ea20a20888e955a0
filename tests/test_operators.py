"""Operators on small tables with hand-checked answers."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reefline.functions import numbers as N
from reefline.functions import text as T
from reefline.operators import clean, coverage, diff, history, levels
from reefline.operators import read_api as R
from reefline.operators.groups import bridge, rollup

STATS = (
    "{'marine_area': 1000.0, 'oecms_pa_marine_area': 100.0, 'percentage_oecms_pa_marine_cover': 10.0, 'pa_marine_area': 80.0, 'percentage_pa_marine_cover': 8.0, "
    "'land_area': 500.0, 'oecms_pa_land_area': 0, 'percentage_oecms_pa_land_cover': 0, 'pa_land_area': None, 'percentage_pa_land_cover': 0, "
    "'protected_area_polygon_count': 6, 'protected_area_point_count': 2, 'oecm_polygon_count': 1, 'oecm_point_count': 1}"
)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_coverage_table(spark):
    countries = spark.createDataFrame([("BRA", 8, STATS)], "id string, pas_count long, statistics string")
    from reefline.plans.rollups import WORLD

    world = spark.createDataFrame(list(WORLD), "type string, value string")
    table, areas = coverage.coverage_table(countries, world, bridge(spark, {"BRA": ["BRA"], "GLOB": []}))
    got = {(r.location, r.environment): r for r in table.collect()}
    assert set(got) == {("BRA", "marine"), ("GLOB", "marine"), ("ABNJ", "marine"), ("GLOB", "terrestrial")}  # no land is protected
    b = got["BRA", "marine"]
    assert (b.protected_area, b.coverage, b.pas, b.oecms, b.total_area, b.protected_areas_count) == (100.0, 10.0, 80.0, 20.0, 1000, 8)
    assert b.global_contribution == pytest.approx(100 * 100 / 1250)
    assert got["ABNJ", "marine"].protected_areas_count == -9999
    assert [r.location for r in areas.collect()] == ["BRA"]
    counts = coverage.group_rows(coverage.country_rows(countries, "marine"), bridge(spark, {"BRA": ["BRA"]}), None, "marine", "counts").first()
    assert (counts.pas, counts.oecms) == (80.0, 20.0)


def test_groups_without_members_or_rows(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", float("nan")), ("B", None)], "location string, v double")
    groups = bridge(spark, {"ab": ["A", "B", "A"], "none": [], "far": ["Z"]})
    assert rows(rollup(df, groups, "location", [N.safe_sum("v").alias("v")]), "location") == [("ab", 1.0)]
    assert rows(rollup(df, groups, "location", [N.safe_sum("v").alias("v")], keep_empty=True), "location") == [("ab", 1.0), ("far", 0.0), ("none", 0.0)]


def test_fishing_table(spark):
    schema = "iso_sov string, iso_ter string, total_area double, lfp5_area double, lfp4_area double, lfp3_area double, lfp2_area double, lfp1_area double"
    data = [("USA", "", 300.0, 9.0, 9.0, 9.0, 9.0, 9.0), ("USA", "NAT", 200.0, 20.0, 10.0, 5.0, 0.0, 1.0), ("USA", "PRI", 100.0, 50.0, 60.0, 0.0, 0.0, 0.0), ("CRV", None, 10.0, 1.0, None, 0.0, 0.0, 0.0), ("OCN", "", 1000.0, 10.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, schema)
    out = levels.fishing_table(df, bridge(spark, {"USA*": ["USA", "PRI"], "PRI": ["PRI"], "HRV": ["HRV"], "GLOB": ["GLOB"], "MEX": ["MEX"]}))
    got = {(r.location, r.fishing_protection_level): (r.area, r.pct, r.total_area) for r in out.collect()}
    assert got["USA*", "highly"] == (140.0, pytest.approx(140 / 3), 300)
    assert got["PRI", "highly"] == (110.0, 100.0, 100)
    assert got["HRV", "highly"] == (1.0, 10.0, 10)
    assert got["GLOB", "highly"] == (10.0, 1.0, 1000)
    assert ("MEX", "highly") not in got


def test_unknown_status_is_an_error(spark):
    df = spark.createDataFrame([(1,), (7,)], "PA_DEF int")
    with pytest.raises(PySparkException, match="unknown PA_DEF"):
        clean.add_status(df).collect()


def test_number_and_text_rules(spark):
    df = spark.createDataFrame([("-", "(1, 2.5)"), ("x", "nope"), ("3", None), ("nan", "[4]")], "a string, b string")
    got = [tuple(r) for r in df.select(N.number("a"), T.float_list("b")).collect()]
    assert got == [(None, [1.0, 2.5]), (None, None), (3.0, None), (None, [4.0])]
    one = spark.range(1).select(N.half_even(F.lit(2.5)), N.half_even(F.lit(3.5)), N.stored(F.lit("0.005")), N.percent(F.lit(1.0), F.lit(0.0)), N.display_percent(F.lit(0.05)), N.display_area(F.lit(1234567.4)), T.identifier(F.lit(1.0), F.lit(None), F.lit("a"), F.lit(12345678.0))).first()
    assert tuple(one) == (2.0, 4.0, 0.01, None, "<0.1", "1,234,567", "1_<NA>_a_12345678")


def test_percents_that_round_to_zero_from_below(spark):
    shown = spark.createDataFrame([(k, v) for k, v in enumerate((-0.04, -0.05, -0.06, 0.25, 12.35, 99.96))], "k int, x double").select("k", N.display_percent("x").alias("t"))
    assert [r.t for r in shown.orderBy("k").collect()] == ["-0.0", "-0.0", "-0.1", "0.2", "12.4", "100.0"]


RECORD = "documentId string, name string, area double, wdpaid long, wdpa_p_id string, zone_id long, environment string, location string, parent struct<wdpaid:long,wdpa_p_id:string,zone_id:long,environment:string,location:string,documentId:string>, children array<struct<wdpaid:long,wdpa_p_id:string,zone_id:long,environment:string,location:string,documentId:string>>"


def record(k, name="a", area=10.0, parent=None, children=None, doc=True):
    rel = lambda i: (i, str(i), None, "marine", "FRA", f"d{i}")
    return (f"d{k}" if doc else None, name, area, k, str(k), None, "marine", "FRA", rel(parent) if parent else None, [rel(c) for c in children] if children else None)


def split(changes):
    return {r.wdpaid for r in changes.new.collect()}, {r.wdpaid for r in changes.changed.collect()}, {r.documentId for r in changes.deleted.collect()}


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ([record(1)], [record(1), record(2)], ({2}, set(), set())),
        ([record(1), record(2)], [record(1)], (set(), set(), {"d2"})),
        ([record(1)], [record(1, name="b")], (set(), {1}, set())),
        ([record(1)], [record(1, name=None)], (set(), set(), set())),
        ([record(1)], [record(1, area=12.0)], (set(), {1}, set())),
        ([record(1)], [record(1, area=10.09)], (set(), set(), set())),
        ([record(1, area=None)], [record(1, area=1.0)], (set(), {1}, set())),
        ([record(1, parent=2), record(2)], [record(1), record(2)], (set(), {1}, set())),
        ([record(1, parent=2), record(2), record(3)], [record(1, parent=3), record(2), record(3)], (set(), {1}, set())),
        ([record(1, children=[2, 3]), record(2), record(3)], [record(1, children=[3, 2]), record(2), record(3)], (set(), set(), set())),
        ([record(1, children=[2]), record(2), record(3)], [record(1, children=[2, 3]), record(2), record(3)], (set(), {1}, set())),
        ([record(1, children=[2]), record(2)], [record(1, children=[9]), record(2)], (set(), {1}, set())),
        ([record(1)], [record(1)], (set(), set(), set())),
    ],
)
def test_snapshot_diff(spark, old, new, want):
    current = spark.createDataFrame(old, RECORD)
    updated = spark.createDataFrame(new, RECORD).drop("documentId")
    assert split(diff.snapshot_diff(current, updated)) == want


def test_duplicates_in_store_are_deleted(spark):
    twice = [record(1), ("d1b", *record(1)[1:])]
    changes = diff.snapshot_diff(spark.createDataFrame(twice, RECORD), spark.createDataFrame([record(1)], RECORD).drop("documentId"))
    assert split(changes) == (set(), set(), {"d1"})


def test_parents(spark):
    data = [("MPATLAS", 5, "5"), ("Protected Planet", 5, "6"), ("Protected Planet", 5, "5"), ("MPATLAS", None, "7")]
    df = spark.createDataFrame([(s, w, p, None, "marine", "FRA") for s, w, p in data], "data_source string, wdpaid long, wdpa_p_id string, zone_id long, environment string, location string")
    got = {(r.data_source, r.wdpa_p_id): (r.parent.wdpa_p_id if r.parent else None, [c.wdpa_p_id for c in r.children] if r.children else None) for r in diff.with_relations(df).collect()}
    assert got == {("Protected Planet", "5"): (None, ["6", "5"]), ("Protected Planet", "6"): ("5", None), ("MPATLAS", "5"): ("5", None)}


def test_sort_specs():
    assert R.sort_spec("a:asc,b.c:desc") == [("a", True), ("b.c", False)]
    assert R.sort_spec({"a": {"b": "desc"}, "c": "asc"}) == [("a.b", False), ("c", True)]
    assert R.sort_spec(["a", {"b": "desc"}]) == [("a", True), ("b", False)]
    with pytest.raises(ValueError, match="unknown operator"):
        R.condition({"a": {"$like": 1}})


def test_pages(spark):
    df = spark.range(60).orderBy("id")
    ids = lambda d: [r.id for r in d.collect()]
    assert len(ids(R.page(df))) == 25
    assert len(ids(R.page(df, limit=-1))) == 60
    assert ids(R.page(df, start=3, limit=2)) == [3, 4]
    assert ids(R.page(df, page=2, page_size=10)) == list(range(10, 20))


def test_projection(spark):
    df = spark.createDataFrame([(2020, 10.0), (2021, 12.0), (2022, 20.0)], "year int, percentage double")
    got = {r.year: r for r in history.projection(df).collect()}
    assert set(got) == set(range(2020, 2031))
    assert (got[2021].historical, got[2022].projected, got[2023].projected, got[2030].projected) == (15.0, 20.0, 25.0, 60.0)
    assert got[2022].active and got[2023].percentage is None


def test_rejects_and_upsert(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    out = diff.upsert(stored, spark.createDataFrame([(2, "B"), (4, "D")], "id long, v string"), ["id"], spark.createDataFrame([(3,)], "id long"))
    assert rows(out, "id") == [(1, "a"), (2, "B"), (4, "D")]
    dim = spark.createDataFrame([("FRA", 10)], "code string, id long")
    good, bad = diff.with_rejects(spark.createDataFrame([("FRA",), ("XXX",), (None,)], "location string"), {"location": (dim, "code", "location_id")})
    assert good.count() == 2 and bad.first().errors == ["location not found: XXX"]
    double = spark.createDataFrame([("FRA", 1), ("FRA", 2), ("DEU", 3), ("DEU", 3)], "code string, id long")
    good, bad = diff.with_rejects(spark.createDataFrame([("FRA",), ("DEU",)], "location string"), {"location": (double, "code", "location_id")})
    assert [tuple(r) for r in good.collect()] == [("DEU", 3)]
    assert [r.errors for r in bad.collect()] == [["location is ambiguous: FRA"]]
