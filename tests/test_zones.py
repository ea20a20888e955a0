"""Zone preparation and the rules of earlier pipelines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reefline.geo import functions as G
from reefline.geo import kernel as K
from reefline.operators import records as R
from reefline.operators import zones as Z
from reefline.operators.groups import bridge


def shapes(spark, rows, names):
    df = spark.createDataFrame([(*r[:-1], K.to_wkb(K.box(*r[-1]))) for r in rows], ", ".join(f"{n} string" for n in names) + ", geometry binary")
    return df


def test_shared_zones(spark):
    df = shapes(spark, [("FRA", "ESP", "FRA", "ESP", "10", (0, 0, 1, 1)), ("FRA", None, "FRA", None, "5", (1, 0, 2, 1)), ("", None, "GBR", None, "7", (5, 5, 6, 6))], ["t1", "t2", "s1", "s2", "AREA_KM2"])
    got = {r.location: (r.AREA_KM2, r.has_shared_marine_area, round(K.area(K.from_wkb(bytes(r.geometry))), 6)) for r in Z.by_claimant(df, ["t1", "t2"], ["s1", "s2"], ["FRA*"]).collect()}
    assert got == {"FRA": (15.0, True, 2.0), "ESP": (10.0, True, 1.0), "GBR": (7.0, False, 1.0), "FRA*": (None, True, 2.0)}


def test_locations_table(spark):
    land = shapes(spark, [("USA", (0, 0, 1, 1)), ("PRI", (2, 0, 3, 1))], ["code"])
    marine = shapes(spark, [("USA", "100.4", (0, 1, 1, 2)), ("MEX", None, (4, 0, 5, 1))], ["code", "AREA_KM2"]).withColumn("has_shared_marine_area", F.col("code") == "USA")
    seas = spark.createDataFrame([("1", "Sea", "12.6", "0", "0", "1", "1")], "MRGID string, NAME string, area string, min_X string, min_Y string, max_X string, max_Y string")
    names = spark.createDataFrame([("USA", "United States", "EU", "EU", "EU"), ("NA", "North America", "a", "b", "c")], "code string, name string, name_es string, name_fr string, name_pt string")
    out = {r.code: r for r in Z.locations_table(land, marine, seas, bridge(spark, {"USA*": ["USA", "PRI"]}), bridge(spark, {"NA": ["USA", "MEX"]}), names).collect()}
    assert set(out) == {"USA", "PRI", "MEX", "USA*", "NA", "1"}
    assert (out["USA"].type, out["USA*"].type, out["NA"].type, out["1"].type) == ("country", "country", "region", "sea")
    assert out["USA"].groups == ["NA", "USA*"] and out["USA*"].members == ["PRI", "USA"]
    assert out["USA"].total_marine_area == 100 and out["1"].total_marine_area == 13 and out["PRI"].total_marine_area == 0
    one = K.area(K.transform(K.box(0, 0, 1, 1), K.equal_area)) / 1e6
    assert out["USA"].total_terrestrial_area == round(one) and out["USA*"].total_terrestrial_area == pytest.approx(2 * one, abs=1)
    assert out["MEX"].total_marine_area == round(one) and out["USA"].terrestrial_bounds == [0.0, 0.0, 1.0, 1.0]
    assert out["USA"].has_shared_marine_area and not out["MEX"].has_shared_marine_area and out["NA"].name == "North America"


def test_sites_peaks_and_mangroves(spark):
    sites = spark.createDataFrame([("p", "x", "50", K.to_wkb(K.box(0, 0, 0, 0)[:0] + [[K.box(1, 1, 1, 1)[0][0][:1]]])), ("q", "-1", "3", K.to_wkb(K.box(0, 0, 1, 1)))], "k string, GIS_AREA string, REP_AREA string, geometry binary")
    got = {r.k: r for r in Z.site_geometries(sites, 0.0001).collect()}
    assert got["q"].bbox == [0.0, 0.0, 1.0, 1.0] and got["q"].calculated_area_km2 == 3.0
    assert K.area(K.transform(K.from_wkb(bytes(got["p"].geometry)), K.equal_area)) / 1e6 == pytest.approx(50, rel=0.01)
    zones = shapes(spark, [("A", (0, 0, 2, 2)), ("B", (2, 0, 4, 2))], ["location"])
    peaks = spark.createDataFrame([(1, 5.0, 1.0, 1.0), (2, 7.0, 9.0, 9.0)], "PEAKID int, AREA2D double, x double, y double").select("PEAKID", "AREA2D", G.st_point("x", "y").alias("geometry"))
    assert [tuple(r) for r in Z.peaks_in(peaks, zones).collect()] == [(1, 5.0, "A")]
    woods = shapes(spark, [("m", (1, 0, 3, 1)), ("n", (1, 0, 2, 1))], ["k"])
    rows = {r.location: r for r in Z.mangroves_by_location(woods, zones, shapes(spark, [("a", (0, 0, 1.5, 1))], ["k"])).collect()}
    cell = K.area(K.transform(K.box(1, 0, 2, 1), K.equal_area)) / 1e6
    assert rows["A"].total_mangrove_area_km2 == pytest.approx(cell) and rows["A"].protected_mangrove_area_km2 == pytest.approx(cell / 2)
    assert rows["B"].total_mangrove_area_km2 == pytest.approx(cell) and rows["B"].protected_mangrove_area_km2 == 0
    united = Z.stitched(zones.withColumnRenamed("location", "NAME"), ["A", "B"], {"NAME": "AB"}).where("NAME = 'AB'").first()
    assert K.area(K.from_wkb(bytes(united.geometry))) == pytest.approx(8)
    tiles = Z.region_tiles(zones, bridge(spark, {"R": ["A", "B"]}), spark.createDataFrame([("R", "Region")], "code string, name string")).first()
    assert (tiles.region_id, tiles.name) == ("R", "Region")


def test_record_rules(spark):
    df = spark.createDataFrame(
        [("Designated", "Park", "None", 5, "full", "2001-02", "1999", None, "4", "FRA;ESP"), ("Proposed", "unesco-mab", "7", 6, "light", None, "", "x", "0", "FRA"), ("Not Reported", None, None, 8, None, None, None, None, None, None)],
        "STATUS string, DESIG_ENG string, wdpa_pid string, wdpa_id long, protection_mpaguide_level string, a string, b string, c string, s string, iso string",
    )
    assert R.reported(df).count() == 1 and R.not_proposed(df).count() == 2
    got = [tuple(r) for r in df.select(R.site_id(), R.level_label(), R.latest_year("a", "b", "c"), R.fishing_class("s")).collect()]
    assert got == [("5", "fully or highly protected", 2001, "highly"), ("7", "less protected or unknown", None, None), ("8", "less protected or unknown", None, None)]
    assert R.one_row_per_code(df, "iso").count() == 3
    assert R.unambiguous(df, "iso", "STATUS").count() == 1
    assert [r[0] for r in spark.createDataFrame([("zone 42b",), ("none",)], "z string").select(R.number_in("z")).collect()] == [42, None]
    assert R.lower_names(df).columns[0] == "status"
    t = spark.createDataFrame([("t", 1), ("t", 1), ("f", 2), (None, 3)], "x string, n int")
    assert sorted((r.n, r.x) for r in R.booleans(t, ["x"]).collect()) == [(1, True), (2, False), (3, None)]
    m = spark.createDataFrame([("A", True, 1), ("A", False, 2), ("B", None, 3)], "iso_sov string, multi_jurisdictional boolean, n int")
    assert sorted(r.n for r in R.fishing_sources(m).collect()) == [1, 3]


def test_formatting(spark):
    df = spark.createDataFrame([("FRA", "b", 3), ("ESP", "a", 1), ("XXX", "c", 2)], "location string, v string, n int")
    codes = spark.createDataFrame([("FRA", 10), ("ESP", 20)], "iso string, location_id int")
    rows = {r.id: r for r in R.formatted(df, codes, {"v": {"a": "A"}}, {"v": "value"}, ["location"], ["n"]).collect()}
    assert {i: (r.value, r.n, r.location_id) for i, r in rows.items()} == {1: ("A", 1, 20), 2: ("c", 2, None), 3: ("b", 3, 10)}
    level = spark.createDataFrame([("FRA", "highly", 2.0, 10.0), ("FRA", "highly", 3.0, 10.0)], "location string, level string, area double, total_area double")
    assert sorted((r.location, r.pct) for r in R.fishing_totals(level, bridge(spark, {"EU": ["FRA"]})).collect()) == [("EU", 50.0), ("FRA", 50.0), ("GLOB", 50.0)]
    s = spark.createDataFrame([("T", "A", 1), ("T", "B", 2)], "t string, s string, n int")
    assert [tuple(r) for r in R.sovereign_of(s, "t", "s", "n").collect()] == [("T", "B")]


def test_sites_are_repaired_once(spark):
    """A filter on validity was pushed below the repair, which then ran twice and before rows were dealt out."""
    rows = [("a", "12", "3", K.to_wkb([[np.array([[10.0, 20.0]])]])), ("b", "0", "5", K.to_wkb([[np.array([[1.0, 2.0]])]])), ("c", "0", "0", K.to_wkb([[np.array([[0, 0], [1, 1], [2, 2], [0, 0]], float)]])), ("d", "1", "1", None)]
    sites = spark.createDataFrame(rows, "id string, GIS_AREA string, REP_AREA string, geometry binary")
    out = Z.site_geometries(sites)
    assert {r.id: round(r.km2, 6) for r in out.select("id", G.st_area_km2("geometry").alias("km2")).collect() if r.id in "ab"} == {"a": 12.0, "b": 5.0}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("st_buffer_km2(") == 1
