"""Readers, writers and streaming flows."""


import json
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from reefline.geo import kernel as K
from reefline.sources import readers as S
from reefline.sources import writers as W
from reefline.streaming import flows


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,v\nNA,1\n,2\n")
    (tmp_path / "b.csv").write_text("\n")
    got = [tuple(r) for r in S.read_csv(spark, str(tmp_path / "a.csv"), "code string, v int").collect()]
    assert got == [("NA", 1), (None, 2)]
    assert S.read_csv(spark, str(tmp_path / "b.csv"), "code string", skip_empty=True).count() == 0
    both = S.read_tagged(spark, {"x": str(tmp_path / "a.csv"), "y": str(tmp_path / "a.csv")}, "code string, v int")
    assert both.groupBy("habitat").count().count() == 2


def test_geojson(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": 7, "properties": {"name": "a", "n": 1}, "geometry": K.to_geojson(K.box(0, 0, 1, 2))}, {"type": "Feature", "id": 8, "properties": {"name": "b"}, "geometry": None}]}
    path = str(tmp_path / "z.geojson")
    (tmp_path / "z.geojson").write_text(json.dumps(fc))
    rows = S.read_geojson(spark, path, "name string, n int", feature_id="zone_id").collect()
    assert [(r.name, r.n, r.zone_id) for r in rows] == [("a", 1, "7"), ("b", None, "8")]
    assert K.area(K.from_wkb(bytes(rows[0].geometry))) == 2 and rows[1].geometry is None
    assert set(S.read_json(spark, path).columns) == {"name", "n", "geometry"}
    with pytest.raises(ValueError, match="neither"):
        S.read_json(spark, "a.txt")
    W.write_geo(S.read_geojson(spark, path, "name string, n int"), str(tmp_path / "out.geojson"))
    line = json.loads(spark.read.text(str(tmp_path / "out.geojson")).orderBy("value").first()[0])
    assert line["geometry"] is None or line["geometry"]["type"] == "Polygon"


def shapefile(name: str) -> dict[str, bytes]:
    shell = K.box(0, 0, 4, 4)[0][0][::-1]
    hole = K.box(1, 1, 2, 2)[0][0]
    points = b"".join(struct.pack("<2d", *p) for r in (shell, hole) for p in r)
    body = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, 10, 0, 5) + points
    record = struct.pack(">2i", 1, len(body) // 2) + body
    null = struct.pack(">2i", 2, 2) + struct.pack("<i", 0)
    shp = b"\0" * 100 + record + null
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    dbf = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, 2, 32 + 32 + 1, 7) + field + b"\r" + b" first " + b" " + b" " * 6
    return {f"in/{name}.shp": shp, f"in/{name}.dbf": dbf}


def test_shapefile_and_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        for part in (shapefile("eez"), shapefile("other")):
            for n, data in part.items():
                z.writestr(n, data)
    rows = S.read_zipped_shapefile(spark, str(tmp_path / "s.zip"), ["NAME", "MISSING"], prefix="eez", valid=True).collect()
    assert [(r.NAME, r.MISSING) for r in rows] == [("first", None), (None, None)]
    assert K.area(K.from_wkb(bytes(rows[0].geometry))) == pytest.approx(15) and rows[1].geometry is None
    assert S.read_zip_members(spark, str(tmp_path / "s.zip"), ".dbf").count() == 2


def test_geopackage(spark, tmp_path):
    file = tmp_path / "g.gpkg"
    db = sqlite3.connect(file)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    for layer in ("adm0", "adm1"):
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", (layer,))
        db.execute(f"CREATE TABLE {layer} (fid INTEGER, GID_0 TEXT, geom BLOB)")
        blob = b"GP\0\x03" + struct.pack("<i4d", 4326, 0, 1, 0, 1) + K.to_wkb(K.box(0, 0, 1, 1))
        db.execute(f"INSERT INTO {layer} VALUES (1, 'FRA', ?)", (blob,))
    db.commit()
    db.close()
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.write(file, "g.gpkg")
    rows = S.read_zipped_gpkg(spark, str(tmp_path / "g.zip"), ["GID_0"], ["adm1"]).collect()
    assert [(r.layer, r.GID_0) for r in rows] == [("adm1", "FRA")] and K.area(K.from_wkb(bytes(rows[0].geometry))) == 1
    assert S.read_zipped_gpkg(spark, str(tmp_path / "g.zip"), ["GID_0"]).count() == 2


def test_services(spark):
    pages = {1: [{"id": 1, "x": "a"}], 2: [{"id": 2}], 3: []}
    failed = []

    def fetch(n):
        if n == 2 and not failed:
            failed.append(n)
            raise OSError("busy")
        return pages[n]

    df = S.from_records(spark, S.paged(fetch), "id long, x string")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a"), (2, None)]

    def one(i):
        if i == 2:
            raise KeyError(i)
        return {"name": f"n{i}"}

    got = {r.id: (r.record and r.record.name, r.error) for r in S.details(df.select("id"), one, "name string").collect()}
    assert got[1] == ("n1", None) and got[2][0] is None and got[2][1].startswith("KeyError")


def test_dated_files_and_maps(spark, tmp_path):
    (tmp_path / "US_LFP3_013124.json").write_text('{"id": 5}')
    assert str(S.dated_files(spark, str(tmp_path / "*LFP*.json"), "id long").first().file_date) == "2024-01-31"
    (tmp_path / "m.json").write_text('{"A": ["x", "y"], "B": []}')
    assert sorted(tuple(r) for r in S.read_map(spark, str(tmp_path / "m.json")).collect() if r.member) == [("A", "x"), ("A", "y")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1 / 3, [1]), ("b", None, None)], "k string, v double, l array<int>")
    W.write_csv(df, str(tmp_path / "c"))
    text = sorted(r[0] for r in spark.read.text(str(tmp_path / "c")).collect())
    assert "a,0.3333333333,[1]" in text and any(t.startswith("b,") for t in text)
    assert W.with_suffix("a/b.parquet", 0.001) == "a/b_0.001.parquet"
    W.write_batches(spark.range(25), str(tmp_path / "b"), ["id"], 10, "json", "v1")
    assert spark.read.json(str(tmp_path / "b")).where("version = 'v1'").count() == 25
    assert len(list((tmp_path / "b").glob("*.json"))) >= 3
    assert [json.loads(r.value) for r in W.without_nulls(df.where("k = 'b'")).collect()] == [{"k": "b"}]
    geo = spark.createDataFrame([("x", K.to_wkb(K.box(0, 0, 20, 1)))], "location string, geometry binary")
    W.replace_pieces(geo, str(tmp_path / "p"))
    assert {"cell_x", "cell_y"} <= set(spark.read.parquet(str(tmp_path / "p")).columns)
    W.write_with_archive(df, str(tmp_path / "now"), str(tmp_path / "then"))
    assert spark.read.parquet(str(tmp_path / "then")).count() == 2
    assert W.move(spark, str(tmp_path / "then"), str(tmp_path / "later"))
    with pytest.raises(ValueError, match="neither"):
        W.write_geo(geo, "a.txt")


def test_streamed_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 2.0), ("2024-01-01 09:00:00", 4.0)]
    df = spark.createDataFrame(rows, "ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = flows.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT n, total FROM windows").collect()
    assert [(r.n, r.total) for r in got] == [(2, 3.0)]  # the last window is still open
