"""Ingest of a source of treatment records as one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlay_jobs.functions import geom as G
from overlay_jobs.functions import labels as L
from overlay_jobs.operators.harmonize import qa_filter
from overlay_jobs.operators.spatial import clip_intersects
from overlay_jobs.sources.tables import save_layer


def ingest_records(df: DataFrame, aoi: DataFrame, statuses: Sequence[str] = ("Completed",), drop_errors: Sequence[str] = ("DUPLICATE_DROP",), year_start: int | None = None, year_end: int | None = None, crs: int | None = None, target_crs: int = G.UTM13N, path: str | None = None, aoi_id: str = "aoi_id") -> DataFrame:
    """Records that pass the QA filters, one row per part and area of interest that the part touches, with YEAR_COMP and GIS_ACRES.

    Geometries are brought to target_crs first; multiparts are taken apart before the clip. path: where the result is saved as a
    layer with its boxes. An empty table gives an empty result with the same columns.
    """
    own = df.withColumn("geometry", G.reproject(F.col("geometry"), crs, target_crs)) if crs and crs != target_crs else df
    own = G.explode_parts(qa_filter(own, statuses, drop_errors, year_start, year_end))
    out = clip_intersects(own, aoi, aoi_id=aoi_id).withColumn("GIS_ACRES", G.area(F.col("geometry")) * L.M2_TO_ACRES)
    if path:
        save_layer(out, path)
    return out
