"""Readers: delimited text, JSON and GeoJSON, Parquet, zipped shapefiles and GeoPackages, paged services."""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.geo import kernel as K


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file in any store; -1 if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getLen() if fs.exists(p) else -1


def read_csv(spark: SparkSession, path: str, schema: str | None = None, *, skip_empty: bool = False, empty_schema: str | None = None, **options: str) -> DataFrame:
    """Delimited text with a header. ``NA`` stays text; an empty field is null. ``skip_empty``: a file of two
    bytes or fewer gives no rows of ``empty_schema`` (or ``schema``)."""
    if skip_empty and file_size(spark, path) <= 2:
        return spark.createDataFrame([], empty_schema or schema or "empty string")
    reader = spark.read.option("header", True).options(**options)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_geojson(spark: SparkSession, path: str, properties: str | None = None, *, feature_id: str | None = None) -> DataFrame:
    """Features as rows: their properties and a WKB ``geometry``. ``properties``: their schema (inferred
    without). ``feature_id``: a column for the features' own id."""
    props = f"properties struct<{properties}>" if properties else "properties string"
    schema = f"features array<struct<id: string, {props.replace(' ', ': ', 1)}, geometry: string>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    if not properties:
        sample = rows.select("f.properties")
        inferred = spark.read.json(sample.where("properties is not null").rdd.map(lambda r: r[0])) if not sample.isEmpty() else None
        if inferred is not None and inferred.columns:
            rows = rows.withColumn("f", F.struct(F.col("f.id").alias("id"), F.from_json("f.properties", inferred.schema).alias("properties"), F.col("f.geometry").alias("geometry")))
    out = rows.select("f.properties.*", F.col("f.id").alias("_id"), F.col("f.geometry").alias("_g")) if properties or "struct" in dict(rows.select("f.properties").dtypes)["properties"] else rows.select(F.col("f.id").alias("_id"), F.col("f.geometry").alias("_g"))
    from reefline.geo.functions import st_from_geojson

    out = out.withColumn("geometry", st_from_geojson("_g"))
    return (out.withColumnRenamed("_id", feature_id) if feature_id else out.drop("_id")).drop("_g")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document; one with features is read as GeoJSON."""
    if not path.lower().endswith((".json", ".geojson")):
        raise ValueError(f"neither .json nor .geojson: {path}")
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return read_geojson(spark, path) if "features" in df.columns else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of lists as rows (grp, member)."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("grp", "_m")).select("grp", F.explode_outer("_m").alias("member"))


def read_tagged(spark: SparkSession, paths: dict[str, str], schema: str, tag: str = "habitat") -> DataFrame:
    """Several CSV files as one table, each row with its file's tag."""
    out = None
    for name, path in paths.items():
        df = read_csv(spark, path, schema).withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


# Archives: each file is one row of binaryFile and is opened by the task that holds it.


def _members(df: pd.DataFrame) -> Iterator[tuple[str, zipfile.ZipFile]]:
    for path, content in zip(df.path, df.content, strict=True):
        yield path, zipfile.ZipFile(io.BytesIO(content))


def read_zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, name, content) of an archive's files."""

    def unzip(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for archive, z in _members(df):
                for n in z.namelist():
                    if n.endswith(suffix) and not n.endswith("/"):
                        yield pd.DataFrame({"archive": [archive], "name": [n], "content": [z.read(n)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "archive string, name string, content binary")


def parse_shp(data: bytes) -> list[bytes | None]:
    """Geometries of a .shp file as WKB: points, multipoints and polygons; null shapes as None."""
    out: list[bytes | None] = []
    at = 100
    while at + 12 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body = data[at + 8 : at + 8 + words * 2]
        at += 8 + words * 2
        (kind,) = struct.unpack_from("<i", body)
        base = kind % 10
        if kind == 0:
            out.append(None)
        elif base == 1:
            out.append(K.to_wkb([[np.frombuffer(body, "<f8", 2, 4).reshape(1, 2).copy()]]))
        elif base == 8:
            (n,) = struct.unpack_from("<i", body, 36)
            out.append(K.to_wkb([[p.reshape(1, 2)] for p in np.frombuffer(body, "<f8", 2 * n, 40).reshape(n, 2).copy()]))
        elif base == 5:
            parts, points = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(points, 2).copy()
            g: K.Geometry = []
            for a, b in zip(starts, starts[1:], strict=False):
                ring = K.closed(xy[a:b])
                if K.ring_area(ring) <= 0 or not g:  # shells run clockwise, holes the other way
                    g.append([ring])
                else:
                    home = next((p for p in reversed(g) if K.contains_points([[p[0]]], ring[:1, 0], ring[:1, 1])[0]), g[-1])
                    home.append(ring)
            out.append(K.to_wkb(g))
        else:
            out.append(None)
    return out


def parse_dbf(data: bytes, encoding: str = "utf-8") -> tuple[list[str], list[list[str | None]]]:
    """Field names and rows of a .dbf file; values as text, blanks as None."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    rows = []
    for k in range(n):
        record = data[head + k * size : head + (k + 1) * size]
        if record[:1] == b"*":
            continue
        row, p = [], 1
        for _, width in fields:
            row.append(record[p : p + width].decode(encoding, "replace").strip() or None)
            p += width
        rows.append(row)
    return [f for f, _ in fields], rows


def read_zipped_shapefile(spark: SparkSession, path: str, columns: list[str], *, prefix: str = "", valid: bool = False) -> DataFrame:
    """Rows of the shapefiles in archives: text ``columns`` and a WKB ``geometry``. ``prefix``: only members
    whose file name begins with it. ``valid``: geometries are repaired."""

    def load(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for _, z in _members(df):
                for n in z.namelist():
                    if not n.lower().endswith(".shp") or not n.split("/")[-1].startswith(prefix):
                        continue
                    shapes = parse_shp(z.read(n))
                    names, rows = parse_dbf(z.read(n[:-4] + (".dbf" if n[:-4] + ".dbf" in z.namelist() else ".DBF")))
                    data = pd.DataFrame(rows, columns=names, dtype=object).reindex(columns=columns).astype(object)
                    data["geometry"] = [K.to_wkb(K.make_valid(K.from_wkb(s))) if valid and s else s for s in shapes]
                    yield data

    schema = "".join(f"`{c}` string, " for c in columns) + "geometry binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, schema)


def gpkg_to_wkb(blob: bytes | None) -> bytes | None:
    """Takes the GeoPackage header off a geometry."""
    if blob is None or blob[:2] != b"GP":
        return blob
    envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    return blob[8 + envelope :]


def gpkg_layers(data: bytes, layers: list[str] | None = None) -> Iterator[tuple[str, pd.DataFrame]]:
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:  # SQLite reads from a file of this task only
        f.write(data)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            found = dict(db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall())
            for name, column in found.items():
                if layers and name not in layers:
                    continue
                df = pd.read_sql_query(f'SELECT * FROM "{name}"', db)
                df["geometry"] = [gpkg_to_wkb(b) for b in df.pop(column)]
                yield name, df
        finally:
            db.close()


def read_zipped_gpkg(spark: SparkSession, path: str, columns: list[str], layers: list[str] | None = None) -> DataFrame:
    """Rows of all or some layers of GeoPackages in archives: ``layer``, text ``columns``, WKB ``geometry``."""

    def load(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for _, z in _members(df):
                for n in z.namelist():
                    if n.endswith(".gpkg"):
                        for name, rows in gpkg_layers(z.read(n), layers):
                            out = rows.reindex(columns=columns).apply(lambda s: s.map(lambda v: None if pd.isna(v) else str(v)))
                            out.insert(0, "layer", name)
                            out["geometry"] = rows["geometry"]
                            yield out

    schema = "layer string, " + "".join(f"`{c}` string, " for c in columns) + "geometry binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, schema)


# Paged services. ``fetch`` is the caller's: an HTTP client, or a list in tests.


def paged(fetch: Callable[[int], list[dict]], *, first: int = 1, attempts: int = 3, wait: float = 0.0) -> Iterator[dict]:
    """Records of pages until one is empty. A page that fails is tried again, a little later each time."""
    n = first
    while True:
        for attempt in range(attempts):
            try:
                records = fetch(n)
                break
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(wait * 2**attempt)
        if not records:
            return
        yield from records
        n += 1


def from_records(spark: SparkSession, records: Iterable[dict], schema: str) -> DataFrame:
    """Records of a service as rows: what isn't in the schema is dropped, what is missing is null."""
    lines = [(json.dumps(r),) for r in records]
    raw = spark.createDataFrame(lines, "value string")
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*")


def details(ids: DataFrame, fetch: Callable[[str], dict], schema: str, attempts: int = 3) -> DataFrame:
    """(id, record, error): one detail record for each id, fetched by the tasks; failures don't stop the rest."""

    def load(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for i in df.iloc[:, 0]:
                value, error = None, None
                for _ in range(attempts):
                    try:
                        value, error = json.dumps(fetch(i)), None
                        break
                    except Exception as e:  # collected, not raised: the caller decides
                        error = f"{type(e).__name__}: {e}"
                rows.append((i, value, error))
            yield pd.DataFrame(rows, columns=["id", "value", "error"])

    kind = ids.dtypes[0][1]
    raw = ids.select(ids.columns[0]).mapInPandas(load, f"id {kind}, value string, error string")
    return raw.select("id", F.from_json("value", schema).alias("record"), "error")


def dated_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON files whose names carry a date as MMDDYY, with it as ``file_date``."""
    name = F.regexp_extract(F.input_file_name(), r"(\d{6})[^/]*$", 1)
    df = spark.read.option("multiLine", True).schema(schema).json(pattern)
    return df.withColumn("file_date", F.try_to_date(F.nullif(name, F.lit("")), "MMddyy"))


def out_of_range(x: str = "x", y: str = "y"):
    """Whether coordinates can't be longitude and latitude."""
    return (F.abs(F.col(x)) > 180) | (F.abs(F.col(y)) > 90)
