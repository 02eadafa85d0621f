"""The registered queries over the driver's tables, and the same in DuckDB SQL (plans/sql.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.functions import geom as G
from overlay_jobs.functions import labels as L
from overlay_jobs.operators import atoms as A
from overlay_jobs.operators import combine as C
from overlay_jobs.operators import flags as P
from overlay_jobs.operators import harmonize as H
from overlay_jobs.operators import ingest as I  # noqa: E741
from overlay_jobs.operators import reconcile as R
from overlay_jobs.operators import spatial as S
from overlay_jobs.plans import adapters as T
from overlay_jobs.plans.sql import ORACLES
from overlay_jobs.session import new_path, settle
from overlay_jobs.sources import tables as R_
from overlay_jobs.sources.crosswalk import default_crosswalk

Query = Callable[[SparkSession, str], DataFrame]
LABELS = ("ATOM_ID", "N_EVENTS", *A.LABELS)


def _joined(c: Column) -> Column:
    return F.concat_ws("|", c.cast("array<string>"))


def _labels(z: DataFrame) -> DataFrame:
    return z.select(*LABELS, _joined(F.col("SOURCE_IDS")).alias("SOURCE_IDS"))


def source_coverage_raw(spark: SparkSession, sf: str) -> DataFrame:
    t = T.treatments(spark, sf)
    frames = {s: t.where(F.col("SOURCE") == s) for s in ("CFT", "TWIG")}
    return R.source_coverage(frames, acres_col="ACRES_GIS")


def dedupe_events(spark: SparkSession, sf: str) -> DataFrame:
    z = T.zones(spark, sf, R.event_deduper(window=(2012, 2014)))
    say = F.transform("EVENTS", lambda e: F.concat_ws(":", e["SOURCE_ID"], F.coalesce(e["ACTIVITY"], F.lit("-")), F.coalesce(e["YEAR_COMP"].cast("string"), F.lit("-")), e["SOURCE"]))
    return z.select("ATOM_ID", F.size("EVENTS").alias("n_events"), F.size("SOURCE_IDS").alias("n_ids"), F.concat_ws("|", say).alias("events"))


def events_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    return A.events_to_rows(T.zones(spark, sf)).drop("PARTNERS", "MGT_TYPE")


def atom_years(spark: SparkSession, sf: str) -> DataFrame:
    return A.years_by_activity(T.zones(spark, sf)).select("ATOM_ID", "ACTIVITY", _joined(F.col("years")).alias("years"))


def extract_field(spark: SparkSession, sf: str) -> DataFrame:
    return A.extract_field(T.zones(spark, sf), "AGENCY_C", "AGENCY_LIST").select("ATOM_ID", "AGENCY_LIST")


def event_json(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON text and back; what comes back is counted."""
    z = T.zones(spark, sf)
    kind = z.schema["EVENTS"].dataType.simpleString()
    back = A.from_json_events(A.to_json_events(F.col("EVENTS")), kind)
    return z.select("ATOM_ID", F.size(back).alias("n"), F.size(F.filter(back, lambda e: e["YEAR_COMP"].isNull())).alias("n_no_year"))


def event_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Events as variants, of every second zone from JSON text, written and read back: fields of every event, and whether the first
    one, read by its path, has an id."""
    z = T.zones(spark, sf).where(F.size("EVENTS") > 0)
    kind = z.schema["EVENTS"].dataType.simpleString()
    own, text = A.to_variant_events(F.col("EVENTS")), A.to_variant_events(A.to_json_events(F.col("EVENTS")), is_text=True)
    v = settle(z.select("ATOM_ID", F.when(F.col("ATOM_ID") % 2 == 0, own).otherwise(text).alias("v")), "event-variants")
    least = F.array_min(F.transform(A.from_variant_events(F.col("v"), kind), lambda e: e["SOURCE_ID"]))
    v = v.select("ATOM_ID", least.alias("least_id"), A.event_field(F.col("v"), 0, "SOURCE_ID", "bigint").isNotNull().alias("has_first"), F.explode(A.from_variant_events(F.col("v"), kind)).alias("e"))
    return v.select("ATOM_ID", "least_id", "has_first", *(f"e.{c}" for c in ("SOURCE_ID", "ACTIVITY", "YEAR_COMP", "AGENCY_C", "FUND_SOURCE", "FUND_TYPE", "LANDOWNER", "SOURCE")))


def _ids(df: DataFrame) -> DataFrame:
    return df.select("ATOM_ID", "TRT_ACTIVITIES")


def acres_by_activity(spark: SparkSession, sf: str) -> DataFrame:
    return A.acres_by(A.events_to_rows(T.zones(spark, sf)), "ACTIVITY")


def acres_by_effect(spark: SparkSession, sf: str) -> DataFrame:
    return T.zones(spark, sf).groupBy("TRT_EFF").agg(F.count("*").alias("atoms"), F.sum("ACRES_GIS").alias("acres"), F.count_if("COMPLETE").alias("complete")).orderBy(F.desc("acres"), "TRT_EFF")


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = T.treatments(spark, sf)
    return t.agg(F.count_distinct("AGENCY_C").alias("agencies"), F.count_distinct("FUND_SOURCE").alias("funds"), F.count_distinct("ACTIVITY").alias("activities"), F.max(F.col("ACTIVITY").isNull()).alias("has_null_activity"), F.min("YEAR_COMP").alias("first_year"), F.max("YEAR_COMP").alias("last_year"), F.sum("ACRES_GIS").alias("acres"))


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return P.flag_acre_mismatch(T.flag_input(spark, sf), n_std=1.5)


def flag_acre_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _flagged(spark, sf).select("OBJECTID", r("acres_diff"), r("log_ac_pred"), r("log_ac_resid"), "ac_flag", "ac_flag_abs")


def unflagged(spark: SparkSession, sf: str) -> DataFrame:
    return P.unflagged(_flagged(spark, sf)).groupBy("ACTIVITY").agg(F.count("*").alias("n"), F.round(F.sum("ACRES_GIS"), 4).alias("acres"))


def _harmonized(spark: SparkSession, sf: str) -> DataFrame:
    return H.harmonize_activity(T.descriptors(spark, sf), default_crosswalk(spark))


def to_event_schema(spark: SparkSession, sf: str) -> DataFrame:
    own = _harmonized(spark, sf).where("ACTIVITY IS NOT NULL").withColumn("year_comp", F.year("treatment_date"))
    return H.to_event_schema(own, "record", id_offset=100).select("OBJECTID", "ACTIVITY", "YEAR_COMP", "FUND_SOURCE", "SOURCE")


def combine_sources(spark: SparkSession, sf: str) -> DataFrame:
    t = T.treatments(spark, sf)
    frames = {s: t.where(F.col("SOURCE") == s).drop("SOURCE") for s in ("CFT", "TWIG")}
    return C.combine_sources(frames).select("OBJECTID", "ACTIVITY", "YEAR_COMP", "AGENCY_C", "SOURCE")


def qa_filters(spark: SparkSession, sf: str) -> DataFrame:
    kept = H.qa_filter(T.descriptors(spark, sf), year_start=1993, year_end=1996)
    return kept.select("record", "status", "error", "YEAR_COMP")


def year_comp_from_ms(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("treatment_date"))
    return e.select("event_id", H.completion_year(e).alias("YEAR_COMP"))


def drop_slivers(spark: SparkSession, sf: str) -> DataFrame:
    return G.drop_slivers(T.boxes(spark, sf), 1800.0).select("OBJECTID", G.area(F.col("geometry")).alias("area"))


def snap_to_grid(spark: SparkSession, sf: str) -> DataFrame:
    own = T.boxes(spark, sf).withColumn("geometry", G.snap(F.col("geometry"), 50.0))
    return own.where(G.not_empty(F.col("geometry"))).select("OBJECTID", G.area(F.col("geometry")).alias("area"))


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    return T.boxes(spark, sf).select("OBJECTID", G.centroid(F.col("geometry")).alias("c"), *(c.alias(n) for n, c in G.bounds(F.col("geometry")).items())).select("OBJECTID", "c.*", "xmin", "ymin", "xmax", "ymax")


def reproject_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """UTM to Mercator and back, in millimetres."""
    moved = F.transform(F.transform("geometry", lambda p: p), lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct((v["x"] + 440000.0).alias("x"), (v["y"] + 4300000.0).alias("y")))))
    own = T.boxes(spark, sf).withColumn("geometry", G.reproject(G.reproject(moved, G.UTM13N, G.MERCATOR), G.MERCATOR, G.UTM13N))
    b = G.bounds(F.col("geometry"))
    return own.select("OBJECTID", F.round(b["xmin"], 3).alias("xmin"), F.round(b["ymin"], 3).alias("ymin"))


def centroid_grid_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return S.grid_heatmap(T.boxes(spark, sf))


def assign_points(spark: SparkSession, sf: str) -> DataFrame:
    own = T.boxes(spark, sf)
    points = own.select(F.col("OBJECTID").alias("point"), (F.col("gx") * T.CELL + 15.0).alias("px"), (F.col("gy") * T.CELL + 15.0).alias("py"))
    pairs = S.assign_points(points, own, "point", "OBJECTID")
    return pairs.groupBy("point").agg(_joined(F.array_sort(F.collect_list("OBJECTID"))).alias("ids"))


def clip_intersects(spark: SparkSession, sf: str) -> DataFrame:
    own = T.boxes(spark, sf).select("OBJECTID", "geometry")
    return S.clip_intersects(own, T.areas_of_interest(spark, sf)).select("OBJECTID", "aoi_id")


def overlay_intersection(spark: SparkSession, sf: str) -> DataFrame:
    own = T.boxes(spark, sf).select("OBJECTID", "geometry")
    return S.overlay_intersection(own, T.areas_of_interest(spark, sf)).select("OBJECTID", "aoi_id", F.round(G.area(F.col("geometry")), 3).alias("area"))


def atomic_cover_areas(spark: SparkSession, sf: str) -> DataFrame:
    z = S.build_atomic_zones(T.boxes(spark, sf), 0.5, 0.0, numbered=False)
    return z.groupBy("cover").agg(F.round(F.sum("area"), 2).alias("area")).select(_joined(F.col("cover")).alias("ids"), "area")


def dissolve_by_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Area of the union of each activity's boxes."""
    own = S.dissolve(T.boxes(spark, sf).select("OBJECTID", "ACTIVITY", "geometry"), ["ACTIVITY"], snap=0.5)
    return own.groupBy("ACTIVITY").agg(F.round(F.sum(G.area(F.col("geometry"))), 1).alias("area"))


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes whose snapped geometry and activity stand more than once."""
    own = T.boxes(spark, sf).withColumn("key", G.geometry_key(F.col("geometry")))
    return own.groupBy("key", "ACTIVITY").agg(F.count("*").alias("n"), F.min("OBJECTID").alias("first_id")).where("n > 1").select("first_id", "n")


def _layer(spark: SparkSession, sf: str) -> DataFrame:
    return S.build_interactions(T.boxes(spark, sf), extra=("SOURCE",))


def build_interactions(spark: SparkSession, sf: str) -> DataFrame:
    own = _layer(spark, sf)
    return own.select(*(c for c in S.LAYER if c not in ("EVENTS", "SOURCE_IDS", "geometry")), _joined(F.col("SOURCE_IDS")).alias("SOURCE_IDS"))


def interactions_by_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Acres of the merged layer by effect."""
    return _layer(spark, sf).groupBy("TRT_EFF").agg(F.round(F.sum("ACRES_GIS"), 2).alias("acres"), F.round(F.sum(F.when(F.col("COMPLETE"), F.col("ACRES_GIS")).otherwise(0.0)), 2).alias("acres_complete"))


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    """Chart data of the merged layer: events per activity and grid cell."""
    own = S.event_points(_layer(spark, sf))
    return S.grid_heatmap(own, x=F.col("x"), y=F.col("y"))


def feature_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes written as pages of features and read back with a filter on their attributes."""
    path = new_path(spark, "pages")
    R_.write_feature_pages(T.boxes(spark, sf), path, ["OBJECTID", "ACTIVITY", "YEAR_COMP"])
    back = R_.read_feature_pages(spark, path, "OBJECTID bigint, ACTIVITY string, YEAR_COMP int", where="YEAR_COMP >= 2010")
    return back.select("OBJECTID", "ACTIVITY", "YEAR_COMP", G.area(F.col("geometry")).alias("area"))


def saved_layer(spark: SparkSession, sf: str) -> DataFrame:
    """A layer that is built and saved with its boxes, read back, and cut to a window by them."""
    path = f"{new_path(spark, 'layers')}/boxes"
    build = lambda: R_.with_bounds(T.boxes(spark, sf).select("OBJECTID", "geometry"))
    R_.read_or_build(spark, path, build)
    again = R_.read_or_build(spark, path, lambda: build().limit(0))  # a limit that must not show: the table is there
    R_.save_layer(again.select("OBJECTID", "geometry"), f"{path}-saved")
    return R_.bbox_prefilter(spark.read.parquet(f"{path}-saved"), (6_000.0, 600.0, 9_000.0, 1_500.0)).select("OBJECTID", "xmin", "ymin", "xmax", "ymax")


def layer_window(spark: SparkSession, sf: str) -> DataFrame:
    """A window of a layer that was saved along a curve: files outside it are not opened."""
    path = new_path(spark, "window")
    R_.save_layer(T.boxes(spark, sf).select("OBJECTID", "geometry"), path)
    return R_.read_window(spark, path, (30_000.0, 300.0, 45_000.0, 2_400.0)).select("OBJECTID", "xmin", "ymin", "xmax", "ymax")


def within_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Treatments clipped to the districts of two codes, which come from a boundary layer of feature pages."""
    path = new_path(spark, "boundaries")
    R_.write_feature_pages(T.districts(spark, sf), path, ["district", "code", "name"])
    areas = R_.read_boundaries(spark, path, "district bigint, code string, name string", "code", ("00", "01"))
    areas = areas.select(F.col("district").alias("aoi_id"), "code", "name", "geometry")
    own = T.boxes(spark, sf).select("OBJECTID", "geometry")
    return S.overlay_intersection(own, areas, attributes=("code", "name")).select("OBJECTID", "aoi_id", "code", "name", F.round(G.area(F.col("geometry")), 3).alias("area"))


def members_of(spark: SparkSession, sf: str) -> DataFrame:
    """Treatments whose customers belong to nations of one region."""
    n = T.table(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey")
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("ZONE"), F.col("c_nationkey").alias("n_nationkey"))
    return R_.members_of(T.treatments(spark, sf), R_.members_of(c, n, "n_nationkey"), "ZONE").select("OBJECTID", "ZONE")


def described_layer(spark: SparkSession, sf: str) -> DataFrame:
    own = T.treatments(spark, sf).select("ZONE", F.col("OBJECTID").alias("old"))
    return C.describe(own, {"PROJECT": "north", "PHASE": 2}, ["ZONE", "old"])


def year_bounds(spark: SparkSession, sf: str) -> DataFrame:
    z = T.zones(spark, sf).withColumn("FIRST_TRT_YEAR", F.when(F.col("ATOM_ID") % 2 == 0, F.col("FIRST_TRT_YEAR"))).drop("LAST_TRT_YEAR")
    return A.fill_year_bounds(z).select("ATOM_ID", "FIRST_TRT_YEAR", "LAST_TRT_YEAR")


def complete_in_order(spark: SparkSession, sf: str) -> DataFrame:
    z = T.zones(spark, sf).select("ATOM_ID", "EVENTS")
    return A.label_events(z, ordered=True).select("ATOM_ID", "COMPLETE")


def activity_order(spark: SparkSession, sf: str) -> DataFrame:
    """Records by activity in the order of charts."""
    t = T.treatments(spark, sf).select(L.activity_rank(F.col("ACTIVITY")).alias("place"), L.activity_category(F.col("ACTIVITY")).alias("category"))
    return t.groupBy("place", "category").agg(F.count("*").alias("n")).orderBy("place")


def first_atom(spark: SparkSession, sf: str) -> DataFrame:
    return A.first_atom(T.zones(spark, sf)).select("ATOM_ID", "N_EVENTS", "TRT_ACTIVITIES")


def overlay_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes cut to areas of interest, with the areas' attributes; a name that both have is told apart."""
    n = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("aoi_id"), F.col("n_name").alias("ACTIVITY"), F.col("n_regionkey").alias("region"))
    areas = T.areas_of_interest(spark, sf).join(n, "aoi_id")
    own = T.boxes(spark, sf).select("OBJECTID", "ACTIVITY", "geometry")
    return S.overlay_intersection(own, areas, attributes=("ACTIVITY", "region")).select("OBJECTID", "aoi_id", "ACTIVITY", "ACTIVITY_aoi", "region", F.round(G.area(F.col("geometry")), 3).alias("area"))


def dissolve_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Equal boxes of an activity as one row, with aggregates of their records."""
    rules = {"records": F.count("*"), "first_year": F.min("YEAR_COMP"), "agencies": F.concat_ws("|", F.array_sort(F.collect_set(F.trim("AGENCY_C"))))}
    out = S.dissolve_duplicates(T.boxes(spark, sf), ["ACTIVITY"], rules)
    return out.where("records > 1").select("OBJECTID", _joined(F.col("ids")).alias("ids"), "records", "first_year", "agencies")


def interactions_pre_dissolved(spark: SparkSession, sf: str) -> DataFrame:
    """Acres by effect of the layer whose equal geometries are noded once: the same as without."""
    own = S.build_interactions(T.boxes(spark, sf), extra=("SOURCE",), pre_dissolve=("ACTIVITY",))
    return own.groupBy("TRT_EFF").agg(F.round(F.sum("ACRES_GIS"), 2).alias("acres"), F.round(F.sum(F.when(F.col("COMPLETE"), F.col("ACRES_GIS")).otherwise(0.0)), 2).alias("acres_complete"))


def explode_parts(spark: SparkSession, sf: str) -> DataFrame:
    own = G.explode_parts(T.second_source(spark, sf).select("record", "geometry"))
    return own.select("record", G.bounds(F.col("geometry"))["xmin"].alias("xmin"), G.area(F.col("geometry")).alias("area"))


def repair_bow_ties(spark: SparkSession, sf: str) -> DataFrame:
    return S.repair_geometry(T.bow_ties(spark, sf)).select("OBJECTID", F.round(G.area(F.col("geometry")), 3).alias("area"), F.size("geometry").alias("parts"))


def zones_by_inner_point(spark: SparkSession, sf: str) -> DataFrame:
    """The sets of boxes around the inner points of all zones."""
    own = T.boxes(spark, sf)
    z = S.assign_treatments(S.build_atomic_zones(own, 0.5, 0.0).select("_atom_id", "px", "py"), own)
    return z.select(_joined(F.col("SOURCE_IDS")).alias("ids")).distinct()


def ingest_second_source(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records through the QA filters, taken apart, clipped and measured."""
    own = I.ingest_records(T.second_source(spark, sf), T.areas_of_interest(spark, sf), year_start=2008, year_end=2012)
    return own.select("record", "aoi_id", "YEAR_COMP", G.bounds(F.col("geometry"))["xmin"].alias("xmin"), F.round("GIS_ACRES", 6).alias("GIS_ACRES"))


def harmonize_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the crosswalk, in several spellings, through the harmoniser."""
    own = H.harmonize_activity(T.crosswalk_records(spark, sf), default_crosswalk(spark))
    return own.select("record", "ACTIVITY", "ACTIVITY_FIELD", "ACTIVITY_STATUS")


def dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    own = T.treatments(spark, sf).select("ZONE", F.col("OBJECTID").alias("old"))
    return C.dense_ids(own, ["ZONE", "old"], "new")


def queries() -> dict[str, Query]:
    named = (source_coverage_raw, dedupe_events, events_to_rows, atom_years, extract_field, event_json, event_variants, acres_by_activity, acres_by_effect, value_counts, flag_acre_mismatch, unflagged, to_event_schema, combine_sources, qa_filters, year_comp_from_ms, drop_slivers, snap_to_grid, centroids, reproject_round_trip, centroid_grid_heatmap, assign_points, clip_intersects, overlay_intersection, atomic_cover_areas, dissolve_by_activity, exact_duplicates, build_interactions, interactions_by_effect, event_points, dense_ids, feature_pages, saved_layer, layer_window, within_boundaries, members_of, described_layer, year_bounds, complete_in_order, activity_order, first_atom, overlay_attributes, dissolve_duplicates, interactions_pre_dissolved, explode_parts, repair_bow_ties, zones_by_inner_point, ingest_second_source, harmonize_crosswalk)
    small: dict[str, Query] = {
        "source_coverage_events": lambda s, d: R.event_coverage(T.zones(s, d)),
        "reconcile_audit": lambda s, d: R.audit(T.zones(s, d)),
        "reconcile_summary": lambda s, d: R.audit_summary(R.audit(T.zones(s, d))),
        "atom_labels": lambda s, d: _labels(T.zones(s, d)),
        "filter_activity_any": lambda s, d: _ids(A.filter_by_activity(T.zones(s, d), ["Mastication", "Removal"])),
        "filter_activity_all": lambda s, d: _ids(A.filter_by_activity(T.zones(s, d), ["Mastication", "Removal"], "all")),
        "filter_year_range": lambda s, d: _ids(A.filter_by_year_range(T.zones(s, d), 2010, 2011)),
        "filter_complete": lambda s, d: _ids(A.filter_complete(T.zones(s, d), "Mechanical + Broadcast Burn")),
        "trt_eff_counts": lambda s, d: T.zones(s, d).groupBy("TRT_EFF").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "TRT_EFF"),
        "numeric_profile": lambda s, d: A.profile(T.treatments(s, d), ["ACRES_GIS", "YEAR_COMP"]),
        "agencies_distinct": lambda s, d: A.distinct_members(T.zones(s, d), "AGENCIES"),
        "flag_by_activity": lambda s, d: P.flags_by_group(_flagged(s, d)),
        "flag_rate_by_size": lambda s, d: P.flag_rate_by_size(_flagged(s, d)),
        "residual_hist": lambda s, d: P.residual_histogram(settle(_flagged(s, d), "flagged")),
        "flag_counts": lambda s, d: P.flag_counts(_flagged(s, d)),
        "share_missing": lambda s, d: P.share_missing(T.flag_input(s, d), ["ACRES_MGT", "ACRES_GIS"]),
        "log_fit": lambda s, d: P.log_fit(T.flag_input(s, d)),
        "harmonize": lambda s, d: _harmonized(s, d).select("record", "ACTIVITY", "ACTIVITY_FIELD", "ACTIVITY_CONF", "ACTIVITY_STATUS", "RAN_CLASSIFY_THIN", "ACRES_REPORTED"),
        "harmonize_summary": lambda s, d: H.harmonize_summary(_harmonized(s, d).withColumn("ACRES_GEO", F.col("acres"))),
        "quarantine_summary": lambda s, d: H.quarantine_summary(_harmonized(s, d).withColumn("ACRES_GEO", F.col("acres"))),
        "area_acres": lambda s, d: T.boxes(s, d).select("OBJECTID", (G.area(F.col("geometry")) * L.M2_TO_ACRES).alias("acres")),
    }
    return {**{f.__name__: f for f in named}, **small}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
