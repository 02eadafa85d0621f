"""Harmonisation of the second source: descriptors through the crosswalk, every record resolved, dropped or quarantined."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.functions import labels as L

# Descriptor fields by specificity, ranks, markers, funding names, words of the classifiers.
PRIMARY = ("activity", "type")
FALLBACK = ("method", "twig_category")
FIELD_RANK = {"activity": 4, "type": 3, "method": 2, "twig_category": 1}
EFFECT_RANK = {"canopy": 2, "surface": 1, "none": 0}
BLANKS = ("", "nan", "none", "n/a", "na")
WILDFIRE = {"twig_category": ("unplanned ignition",), "method": ("wildfire",), "category": ("wildfire non-treatment",)}
FUNDING = {"BIL": "Bipartisan Infrastructure Law (BIL)", "CFLR": "Collaborative Forest Landscape Restoration (CFLR)"}
THIN_WORDS = ("sanitation cut", "improvement cut", "group selection cut", "overstory removal cut", "salvage cut", "recreation removal", "salvage")
MANUAL_EQUIPMENT = ("chain saw", "hand work", "hand saw", "manual logging")
MACHINE_EQUIPMENT = ("feller buncher", "tree shear", "dozer", "masticator", "rubber tired skidder logging", "helicopter logging -medium", "helicopter logging -small")
MANUAL_METHODS = ("manual", "power hand", "manual logging", "cut trees and brush")
MACHINE_METHODS = ("mechanical", "tractor logging", "logging methods", "helicopter", "removal")
FIRE_WORDS = ("fire", "prescribed burn", "broadcast", "jackpot", "underburn")
HAND_WORDS = ("manual", "hand", "cut trees", "power hand", "girdle")
MACHINE_WORDS = ("mechanical", "masticat", "tractor", "dozer", "grind", "mow", "mobile ground", "logging", "crush", "push", "feller", "shear", "skidder")


def _columns(df: DataFrame) -> Callable[[str], Column]:
    return lambda name: F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _plain(c: Column) -> Column:
    return F.coalesce(F.lower(L.strip(c)), F.lit(""))


def _has(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


Getter = Callable[[str], Column]


def classify_thin(get: Getter) -> Column:
    """Manual or Mechanical by equipment, then method; null if the record is no thinning."""
    kind, activity, equipment, method = (_plain(get(x)) for x in ("type", "activity", "equipment", "method"))
    thin = (kind == "thinning") | _has(activity, ("thin", *THIN_WORDS))
    how = F.when(equipment.isin(*MANUAL_EQUIPMENT), "Manual").when(equipment.isin(*MACHINE_EQUIPMENT), "Mechanical").when(method.isin(*MANUAL_METHODS), "Manual").otherwise("Mechanical")
    return F.when(thin, how)


def classify_range(get: Getter) -> Column:
    return F.when(_has(_plain(get("method")), FIRE_WORDS), "Prescribed Burn (Range)").otherwise("DROP")


def classify_release(get: Getter, thin: Callable[[Getter], Column] = classify_thin) -> Column:
    method = _plain(get("method"))
    return F.when(_has(method, ("chemical",)), F.lit("DROP")).when(_plain(get("type")) == "thinning", F.coalesce(thin(get), F.lit("Mechanical"))).when(_has(method, HAND_WORDS), F.lit("Lop and Scatter")).when(_has(method, MACHINE_WORDS), F.lit("Mastication"))


def is_wildfire(get: Getter) -> Column:
    out = F.lit(False)
    for field, marks in WILDFIRE.items():
        out = out | _plain(get(field)).isin(*marks)
    return out


def harmonize_activity(df: DataFrame, crosswalk: DataFrame, thin_classifier: Callable[[Getter], Column] = classify_thin, acres_col: str = "acres", area: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds ACTIVITY, ACTIVITY_FIELD, ACTIVITY_CONF, ACTIVITY_STATUS, RAN_CLASSIFY_THIN, ACRES_REPORTED and ACRES_GEO.

    The crosswalk has one row per (field, value): a few hundred at most, checked here, so it is looked up as broadcast tables and
    the records are not shuffled. Without an area function or geometry ACRES_GEO is null. ACRES_REPORTED must not be summed. As Spark
    does not tell ACTIVITY from activity, the descriptor moves to activity_raw.
    """
    known = crosswalk.select("field", "value", "activity", "effect", "confidence")
    if known.limit(10_001).count() > 10_000:
        raise ValueError("a crosswalk has 10,000 rows at most")
    get = _columns(df)
    out = df
    candidates: dict[str, Column] = {}
    for field in (*PRIMARY, *FALLBACK):
        rank = F.when(F.col("effect") == "canopy", 2).when(F.col("effect") == "surface", 1).otherwise(0)
        side = known.where(F.col("field") == field).select(F.col("value").alias(f"_v_{field}"), F.struct(rank.alias("effect"), F.lit(FIELD_RANK[field]).alias("rank"), F.col("activity").alias("target"), F.col("confidence").alias("conf"), F.lit(field).alias("field")).alias(f"_c_{field}"))
        value = L.strip(get(field))
        key = F.when(~F.lower(value).isin(*BLANKS), value)
        out = out.join(F.broadcast(side), key == F.col(f"_v_{field}"), "left").drop(f"_v_{field}")
        candidates[field] = F.col(f"_c_{field}")

    def pick(fields: Sequence[str]) -> Column:
        return F.greatest(*(F.when((candidates[f]["target"] != "DROP") & (candidates[f]["effect"] > 0), candidates[f]) for f in fields))

    out = out.withColumns({"_prim": pick(PRIMARY), "_fall": pick(FALLBACK)})
    out = out.withColumn("_veto", F.col("_prim").isNull() & is_wildfire(get)).withColumn("_chosen", F.when(~F.col("_veto"), F.coalesce("_prim", "_fall")))
    target = F.col("_chosen.target")
    final = F.when(target == "Thin", F.coalesce(thin_classifier(get), F.lit("Mechanical"))).when(target == "Range", classify_range(get)).when(target == "Release", classify_release(get, thin_classifier)).otherwise(target)
    dropped = F.coalesce(*(F.when(candidates[f]["target"] == "DROP", F.lit(f)) for f in (*PRIMARY, *FALLBACK)))
    out = out.withColumns({"_final": final, "_dropped": dropped})
    chosen = F.col("_chosen").isNotNull()
    status = F.when(F.col("_veto"), "dropped").when(chosen, F.when(F.col("_final") == "DROP", "dropped").when(F.col("_final").isNull(), "quarantined").otherwise("resolved")).when(F.col("_dropped").isNotNull(), "dropped").otherwise("quarantined")
    out = out.withColumn("_status", status)
    resolved = F.col("_status") == "resolved"
    added = {
        "ACTIVITY": F.when(resolved, F.col("_final")),
        "ACTIVITY_FIELD": F.when(F.col("_veto"), F.lit("wildfire")).when(chosen, F.col("_chosen.field")).otherwise(F.col("_dropped")),
        "ACTIVITY_CONF": F.when(resolved, F.col("_chosen.conf")),
        "ACTIVITY_STATUS": F.col("_status"),
        "RAN_CLASSIFY_THIN": F.coalesce(target == "Thin", F.lit(False)),
        "ACRES_REPORTED": F.col(acres_col).try_cast("double") if acres_col in df.columns else F.lit(None).cast("double"),
        "ACRES_GEO": area(F.col("geometry")) * L.M2_TO_ACRES if area is not None and "geometry" in df.columns else F.lit(None).cast("double"),
    }
    if "activity" in df.columns:
        out = out.withColumn("activity_raw", F.col("activity"))
    return out.withColumns(added).drop(*(f"_c_{f}" for f in candidates), "_prim", "_fall", "_veto", "_chosen", "_final", "_dropped", "_status")


def harmonize_summary(annotated: DataFrame) -> DataFrame:
    """Records, footprint acres and classified thinnings per status; a status without records shows zeros."""
    spark = annotated.sparkSession
    states = spark.createDataFrame([(0, "resolved"), (1, "dropped"), (2, "quarantined")], "place int, ACTIVITY_STATUS string")
    counts = annotated.groupBy("ACTIVITY_STATUS").agg(F.count("*").alias("n"), F.sum("ACRES_GEO").alias("a"), F.count_if("RAN_CLASSIFY_THIN").alias("t"))
    zero = F.lit(0).cast("long")
    return states.join(counts, "ACTIVITY_STATUS", "left").orderBy("place").select("ACTIVITY_STATUS", F.coalesce("n", zero).alias("records"), F.coalesce("a", F.lit(0.0)).alias("acres"), F.coalesce("t", zero).alias("n_thin"))


def quarantine_summary(annotated: DataFrame) -> DataFrame:
    own = annotated.where("ACTIVITY_STATUS = 'quarantined'")
    fields = [F.col("activity_raw").alias("activity") if f == "activity" else F.col(f) for f in (*PRIMARY, *FALLBACK) if f in annotated.columns or (f == "activity" and "activity_raw" in annotated.columns)]
    return own.groupBy(*fields).agg(F.count("*").alias("records"), F.coalesce(F.sum("ACRES_GEO"), F.lit(0.0)).alias("acres"))


def recode(c: Column, names: Mapping[str, str]) -> Column:
    """A small map over a column; unknown values stay."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(table, c), c)


def to_event_schema(df: DataFrame, row_id: Column | str, source_label: str = "TWIG", id_offset: int = 0) -> DataFrame:
    """A harmonised table with the event fields, SOURCE and OBJECTID = id_offset + row_id (1-based, see combine.dense_ids).

    ValueError without an ACTIVITY column or with records whose ACTIVITY is null.
    """
    if "ACTIVITY" not in df.columns:
        raise ValueError("no ACTIVITY column: harmonise first")
    if df.where(F.col("ACTIVITY").isNull()).limit(1).count():
        raise ValueError("records without ACTIVITY: drop them first")
    given = {"ACTIVITY": F.col("ACTIVITY")}
    lower = {c.lower(): c for c in df.columns}
    if "fund_source" in df.columns:
        given["FUND_SOURCE"] = recode(F.col("fund_source"), FUNDING)
    if "AGENCY_C" not in df.columns and "agency" in df.columns:
        given["AGENCY_C"] = F.col("agency")
    if "year_comp" in lower:
        given["YEAR_COMP"] = F.col(lower["year_comp"]).cast("int")
    fields = [given.get(f, F.col(f) if f in df.columns else F.lit(None).cast("int" if f == "YEAR_COMP" else "string")).alias(f) for f in L.EVENT_FIELDS]
    key = F.col(row_id) if isinstance(row_id, str) else row_id
    rest = ["geometry"] if "geometry" in df.columns else []
    return df.select((F.lit(id_offset) + key).cast("long").alias("OBJECTID"), *fields, F.lit(source_label).alias("SOURCE"), *rest)


def completion_year(df: DataFrame, col: str = "treatment_date") -> Column:
    """Year in UTC of a date that is epoch milliseconds in a number column, or text or a timestamp; what can't be read is null.

    The session's time zone has no part in it: text without a zone is in UTC, as is a timestamp without one.
    """
    kind = dict(df.dtypes)[col]
    utc = lambda ms: F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")))
    if kind in ("bigint", "int", "smallint", "tinyint", "double", "float") or kind.startswith("decimal"):
        return utc(F.col(col).try_cast("long"))
    if kind == "timestamp":
        return utc(F.unix_millis(F.col(col)))
    if kind != "string":
        return F.year(F.col(col))
    zoned = F.col(col).rlike(r"[0-9]:[0-9]{2}.*([zZ]|UTC|GMT|[+-][0-9]{1,2}(:?[0-9]{2})?)\s*$")
    return F.when(zoned, utc(F.unix_millis(F.col(col).try_cast("timestamp")))).otherwise(F.year(F.col(col).try_cast("timestamp_ntz")))


def qa_filter(df: DataFrame, statuses: Sequence[str] = ("Completed",), drop_errors: Sequence[str] = ("DUPLICATE_DROP",), year_start: int | None = None, year_end: int | None = None) -> DataFrame:
    """Records of some statuses without some error marks; then YEAR_COMP from treatment_date, and its bounds.

    An empty list filters nothing; a null status goes, a null error stays, a null year goes once there is a bound.
    """
    if statuses:
        df = df.where(F.col("status").isin(*statuses))
    if drop_errors and "error" in df.columns:
        df = df.where(~F.coalesce(F.col("error").isin(*drop_errors), F.lit(False)))
    if "treatment_date" in df.columns:
        df = df.withColumn("YEAR_COMP", completion_year(df))
    if "YEAR_COMP" in df.columns:
        df = df.where(F.col("YEAR_COMP") >= year_start) if year_start is not None else df
        df = df.where(F.col("YEAR_COMP") <= year_end) if year_end is not None else df
    return df
