"""Sources on one schema, with dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlay_jobs.functions import geom as G
from overlay_jobs.functions.labels import EVENT_FIELDS
from overlay_jobs.session import settle


def dense_ids(df: DataFrame, order: list[str], name: str = "OBJECTID", start: int = 1) -> DataFrame:
    """Adds start, start + 1 ... in the order of columns (nulls first), without a sort in one task.

    Rows are sorted by ranges; each partition numbers its own rows; sizes of partitions (one number each) give the offsets.
    Rows that tie in all the columns get their numbers in any order, and are spread by their place in the input.
    """
    df, order = df.withColumn("_tie", F.monotonically_increasing_id()), [*order, "_tie"]
    placed = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "dense-ids")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_least"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, (F.col("_row") - F.col("_least") + F.col("_before") + start).cast("long")).drop("_part", "_row", "_least", "_before", "_tie")


def describe(df: DataFrame, constants: dict[str, object], order: list[str], name: str = "OBJECTID") -> DataFrame:
    """A project layer with constant descriptor columns and a row id from 1 in the order of columns."""
    return dense_ids(df.withColumns({k: F.lit(v) for k, v in constants.items()}), order, name)


def combine_sources(frames: dict[str, DataFrame], keep: list[str] | None = None, crs: dict[str, int] | None = None, target_crs: int | None = None, id_col: str = "OBJECTID") -> DataFrame:
    """All sources on the event schema with one dense OBJECTID, by source in the order given and then by the old id.

    SOURCE is the key where a source has none; missing event fields are null. crs: EPSG code by source; geometries go to
    target_crs, by default the first source's.
    """
    if not frames:
        raise ValueError("no source given")
    keep = list(keep or ["OBJECTID", *EVENT_FIELDS, "SOURCE", "geometry"])
    target = target_crs or (crs or {}).get(next(iter(frames)))
    parts = None
    for n, (name, df) in enumerate(frames.items()):
        if "SOURCE" not in df.columns:
            df = df.withColumn("SOURCE", F.lit(name))
        if "geometry" in df.columns and target and (own := (crs or {}).get(name, target)) != target:
            df = df.withColumn("geometry", G.reproject(F.col("geometry"), own, target))
        for f in EVENT_FIELDS:
            if f not in df.columns:
                df = df.withColumn(f, F.lit(None).cast("int" if f == "YEAR_COMP" else "string"))
        old = F.col(id_col).cast("long") if id_col in df.columns else F.monotonically_increasing_id()
        df = df.select(F.lit(n).alias("_source"), old.alias("_old"), *(c for c in keep if c != "OBJECTID" and c in df.columns))
        parts = df if parts is None else parts.unionByName(df, allowMissingColumns=True)
    out = dense_ids(parts, ["_source", "_old"], "OBJECTID")
    return out.select("OBJECTID", *(c for c in keep if c != "OBJECTID" and c in out.columns))
