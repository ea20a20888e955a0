"""Writers: CSV with fixed decimals, GeoJSON or Parquet, partitioned pieces, batches, dated copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_suffix(path: str, tolerance: float | None) -> str:
    """``name.ext`` with a tolerance in its name."""
    if tolerance is None:
        return path
    stem, dot, ext = path.rpartition(".")
    return f"{stem}_{tolerance}{dot}{ext}" if dot else f"{path}_{tolerance}"


def write_csv(df: DataFrame, path: str, decimals: int = 10, mode: str = "overwrite") -> None:
    """CSV with a header; floating numbers with fixed decimals, nested columns as JSON."""

    def shown(c: str, t: str):
        if t in ("double", "float"):
            return F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if decimals is not None else F.col(c)
        return F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c)

    out = df.select(*[F.when(F.col(c).isNotNull(), shown(c, t)).alias(c) for c, t in df.dtypes])
    out.write.mode(mode).option("header", True).csv(path)


def write_geo(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By suffix: .parquet, or .geojson / .json (one feature a line)."""
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
        return
    if not path.endswith((".geojson", ".json")):
        raise ValueError(f"neither .parquet nor .geojson: {path}")
    from reefline.geo.functions import st_as_geojson

    rest = [c for c in df.columns if c != "geometry"]
    properties = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    line = F.concat(F.lit('{"type": "Feature", "properties": '), properties, F.lit(', "geometry": '), F.coalesce(st_as_geojson("geometry"), F.lit("null")), F.lit("}"))
    df.select(line.alias("value")).write.mode(mode).text(path)


def replace_pieces(df: DataFrame, path: str, most: int = 10_000, size: float = 10.0) -> None:
    """The stored analysis pieces: polygons cut to a bounded number of vertices, in folders by grid cell."""
    from reefline.geo.functions import st_bounds, st_subdivide

    pieces = df.withColumn("geometry", F.explode(st_subdivide("geometry", most)))
    b = pieces.withColumn("_b", st_bounds("geometry"))
    cells = b.withColumns({"cell_x": F.floor(F.col("_b.minx") / size), "cell_y": F.floor(F.col("_b.miny") / size)}).drop("_b")
    cells.write.mode("overwrite").partitionBy("cell_x", "cell_y").parquet(path)


def write_batches(df: DataFrame, path: str, order: list[str], rows: int, form: str = "csv", version: str | None = None) -> None:
    """Files of at most ``rows`` rows in key order; JSON batches carry a version."""
    out = df.withColumn("version", F.lit(version)) if version and form == "json" else df
    writer = out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", rows)
    writer.option("header", True).format(form).save(path)


def write_with_archive(df: DataFrame, path: str, archive: str) -> None:
    """A table and its dated copy; the copy is made from what was written."""
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).write.mode("overwrite").parquet(archive)


def without_nulls(df: DataFrame) -> DataFrame:
    """Rows as JSON objects that lack the keys whose value is missing."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def move(df_or_session, source: str, target: str) -> bool:
    """Renames a file or folder in its store."""
    spark = getattr(df_or_session, "sparkSession", df_or_session)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.rename(path(source), path(target))
