"""Reading and writing layers: feature pages, cached tables, crosswalks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlay_jobs.functions import geom as G
from overlay_jobs.functions.labels import strip
from overlay_jobs.session import discard, settle

#: Features of a page that is written.
PAGE_ROWS = 1_000
#: Bits of a place on the curve that layers are sorted by, for each axis; bytes of a row group; the table of files' boxes, whose name
#: hides it from readers of the layer.
CURVE_BITS, ROW_GROUP_BYTES, BOXES = 16, 16 << 20, "_boxes"
CROSSWALK_COLS = ("field", "value", "activity", "effect", "confidence")


def no_nan(df: DataFrame) -> DataFrame:
    """Missing numbers as null: NaN compares above every number, and flags would come out true."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def read_feature_pages(spark: SparkSession, paths: str | list[str], properties: str, where: str | None = None, crs: tuple[int, int] | None = None) -> DataFrame:
    """Pages of GeoJSON features, one file each, as one table of properties and `geometry`.

    properties: DDL of the attributes to read. Pages without features add nothing; no features at all give an empty table with
    the same columns. where: SQL filter on attributes. crs: (from, to) EPSG codes.
    """
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(paths).select(F.explode("features").alias("f"))
    ring = "array<array<array<double>>>"
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(raw, ring))).when(kind == "MultiPolygon", F.from_json(raw, f"array<{ring}>"))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    geometry = F.transform(parts, lambda part: F.transform(part, lambda r: F.transform(r, point)))
    out = no_nan(features.select("f.properties.*", geometry.alias("geometry")))
    out = out.where(where) if where else out
    return out.withColumn("geometry", G.reproject(F.col("geometry"), *crs)) if crs else out


def with_bounds(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Adds xmin, ymin, xmax, ymax: a scan with a box then skips row groups by their statistics."""
    return df.withColumns(G.bounds(F.col(geometry)))


def bbox_prefilter(df: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose stored box meets the bounds (xmin, ymin, xmax, ymax)."""
    x0, y0, x1, y1 = bounds
    return df.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path; if there is none yet it is built, saved and read back."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _along_curve(df: DataFrame, files: int | None) -> DataFrame:
    """Settled rows with boxes, dealt to files and sorted by where their boxes' middles lie on a Hilbert curve; boxless rows first."""
    x0, y0, x1, y1 = df.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).head()
    if x0 is None:
        return df
    place = lambda lo, hi, least, most: F.floor((F.col(lo) / 2 + F.col(hi) / 2 - least) / max(most - least, 1e-9) * (2**CURVE_BITS - 1))
    df = df.withColumn("_curve", G.hilbert(place("xmin", "xmax", x0, x1), place("ymin", "ymax", y0, y1), CURVE_BITS))
    # a row's own number parts equal places, so that a spot with very many rows is several files
    df = df.withColumn("_row", F.monotonically_increasing_id())
    keys = ("_curve", "_row")
    dealt = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).drop(*keys)


def save_layer(df: DataFrame, path: str, json_cols: Sequence[str] = (), files: int | None = None) -> None:
    """Write a layer; json_cols are written as JSON text with their nulls.

    A layer with a geometry is written with its boxes, rows that lie near each other in one file and one row group, and beside the
    files a table of their boxes (BOXES), by which read_window() leaves out files. files: how many, else as many as Spark makes of
    its advisory size. Rows without a geometry, empty ones included, stand first; an empty layer is written as such.
    """
    df = df.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in json_cols})
    if "geometry" not in df.columns:
        df.write.mode("overwrite").parquet(path)
        return
    own = settle(with_bounds(df), "layer")
    _along_curve(own, files).write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    discard(own)
    rows = df.sparkSession.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), "xmin", "ymin", "xmax", "ymax")
    boxes = rows.groupBy("file").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    boxes.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BOXES}")


def read_window(spark: SparkSession, path: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Rows of a saved layer whose box meets the bounds (xmin, ymin, xmax, ymax). Files that lie outside are not opened; in the others
    row groups are skipped by their statistics. A layer without a table of boxes is read whole. The names of the files that meet the
    bounds come to the driver, as they do for any table that Spark reads."""
    path = path.rstrip("/")
    if not exists(spark, f"{path}/{BOXES}/_SUCCESS"):
        return bbox_prefilter(spark.read.parquet(path), bounds)
    files = [r[0] for r in bbox_prefilter(spark.read.parquet(f"{path}/{BOXES}"), bounds).select("file").collect()]
    whole = spark.read.parquet(path)
    if not files:
        return whole.where(F.lit(False))
    return bbox_prefilter(spark.read.schema(whole.schema).parquet(*(f"{path}/{f}" for f in files)), bounds)


def read_boundaries(spark: SparkSession, paths: str | list[str], properties: str, column: str, values: Sequence[str], crs: tuple[int, int] | None = None) -> DataFrame:
    """Boundaries of a layer of feature pages by name or code: all features whose `column` is one of `values`, their attributes and
    `geometry`. A name that stands on several features gives all of them; codes are compared as text, so "08" is not 8; names that
    stand on no feature are a ValueError. crs: as in read_feature_pages()."""
    found = read_feature_pages(spark, paths, properties, crs=crs).where(F.col(column).isin(*values))
    there = {r[0] for r in found.select(F.col(column).cast("string")).distinct().collect()}  # at most the values asked for
    if missing := sorted(set(values) - there):
        raise ValueError(f"no boundary whose {column} is {', '.join(missing)}")
    return found


def load_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """A crosswalk CSV, stripped; ValueError if a (field, value) stands in it twice."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    return check_crosswalk(raw.select(*(strip(F.col(c)).alias(c) for c in CROSSWALK_COLS)))


def check_crosswalk(crosswalk: DataFrame) -> DataFrame:
    twice = crosswalk.groupBy("field", "value").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"crosswalk keys that stand twice: {[(r[0], r[1]) for r in twice]}")
    return crosswalk


def members_of(df: DataFrame, others: DataFrame, on: str) -> DataFrame:
    """Rows whose key stands in another table."""
    return df.join(others.select(on), on, "left_semi")


def write_feature_pages(df: DataFrame, path: str, properties: list[str]) -> None:
    """A layer as pages of GeoJSON features that read_feature_pages() reads, one file each, of PAGE_ROWS features at most."""
    point = lambda v: F.array(v["x"], v["y"])
    parts = F.transform("geometry", lambda p: F.transform(p, lambda r: F.transform(r, point)))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates"))
    features = df.select(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry")).alias("f"))
    pages = features.withColumn("page", F.floor(F.monotonically_increasing_id() / PAGE_ROWS)).groupBy("page").agg(F.collect_list("f").alias("features"))
    pages.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"), {"ignoreNullFields": "false"}).alias("value"), "page").write.partitionBy("page").text(path)
