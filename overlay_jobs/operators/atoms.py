"""Zones and their events: aggregation, labels, filters, flat views and summaries."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.functions import labels as L
from overlay_jobs.operators.quantiles import SMALL, exact_quantiles
from overlay_jobs.session import settle

LABELS = ("TRT_ACTIVITIES", "TRT_EFF", "TRT_SET", "FIRST_TRT", "LAST_TRT", "FIRST_TRT_YEAR", "LAST_TRT_YEAR", "COMPLETE", "LAST_THIN", "CANOPY", "SURFACE", "AGENCIES", "FUND_SOURCES")


def label_events(atoms: DataFrame, events: str = "EVENTS", ordered: bool = False, analysis_start: int = 2014) -> DataFrame:
    """Adds the label columns of each zone's event array. ordered: complete only if a burn does not come before every thinning."""
    base = atoms.withColumn("_counted", L.labelled(F.col(events)))
    base = base.withColumn("_present", L.activities(F.col("_counted")))
    years = F.transform("_counted", lambda e: e["YEAR_COMP"])
    base = base.withColumns({"_set": L.ordered_set(F.col("_present")), "_first": F.array_min(years), "_last": F.array_max(years)})
    empty = F.size("_present") == 0
    every = F.transform(F.col(events), lambda e: e["YEAR_COMP"])
    thin, burn = L.years_of(F.col("_counted"), L.THIN_TYPES), L.years_of(F.col("_counted"), L.BURN_TYPES)
    complete = L.any_of(F.col("_present"), L.THIN_TYPES) & L.any_of(F.col("_present"), L.BURN_TYPES)
    if ordered:
        complete = F.coalesce(F.array_min(burn) >= F.array_min(thin), F.lit(False))
    out = base.withColumns(
        {
            "TRT_ACTIVITIES": F.when(empty, F.lit("Unknown")).otherwise(F.concat_ws("|", "_set")),
            "TRT_EFF": L.effect(F.col("_present")),
            "TRT_SET": F.when(empty, F.lit("Unknown")).otherwise(F.concat_ws(" + ", "_set")),
            "FIRST_TRT": L.type_at(F.col("_counted"), F.col("_first")),
            "LAST_TRT": L.type_at(F.col("_counted"), F.col("_last")),
            "FIRST_TRT_YEAR": F.array_min(every),
            "LAST_TRT_YEAR": F.array_max(every),
            "COMPLETE": complete,
            "LAST_THIN": F.array_max(F.filter(thin, lambda y: y >= analysis_start)),
            "CANOPY": L.group_members(F.col("_present"), L.GROUPS["CANOPY"]),
            "SURFACE": L.group_members(F.col("_present"), L.GROUPS["SURFACE"]),
            "AGENCIES": L.pipe_set(F.transform(F.col(events), lambda e: e["AGENCY_C"])),
            "FUND_SOURCES": L.pipe_set(F.transform(F.col(events), lambda e: e["FUND_SOURCE"])),
        }
    )
    return out.drop("_counted", "_present", "_set", "_first", "_last")


def aggregate_events(links: DataFrame, source: DataFrame, atom_col: str = "_atom_id", id_col: str = "OBJECTID", extra: tuple[str, ...] = (), dedupe: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per zone with EVENTS (by source id), SOURCE_IDS, N_EVENTS and the labels.

    links: zone and source id, one row per pair. Zones without a source vanish. A field of `extra` that the source lacks is left
    out with a warning; with a dedupe hook SOURCE is carried along. The hook works on the array before labels; ids stay as they were.
    """
    wanted = [*L.EVENT_FIELDS, *(f for f in extra if f not in L.EVENT_FIELDS)]
    if dedupe is not None and "SOURCE" in source.columns and "SOURCE" not in wanted:
        wanted.append("SOURCE")
    for f in [f for f in extra if f not in source.columns]:
        warnings.warn(f"no column {f} in the source: left out", stacklevel=2)
    wanted = [f for f in wanted if f in source.columns]
    fields = [F.col(f).try_cast("int").alias(f) if f == "YEAR_COMP" else F.col(f) for f in wanted]
    own = source.select(F.col(id_col).cast("long").alias("SOURCE_ID"), *fields)
    for f in L.EVENT_FIELDS:
        if f not in wanted:
            own = own.withColumn(f, F.lit(None).cast("int" if f == "YEAR_COMP" else "string"))
    pairs = links.where(F.col(id_col).isNotNull()).select(F.col(atom_col), F.col(id_col).cast("long").alias("SOURCE_ID"))
    event = F.struct("SOURCE_ID", *L.EVENT_FIELDS, *(f for f in wanted if f not in L.EVENT_FIELDS))
    grouped = pairs.join(own, "SOURCE_ID").groupBy(atom_col).agg(F.sort_array(F.collect_list(event)).alias("EVENTS"))
    grouped = grouped.withColumn("SOURCE_IDS", F.transform("EVENTS", lambda e: e["SOURCE_ID"]))
    if dedupe is not None:
        grouped = grouped.withColumn("EVENTS", dedupe(F.col("EVENTS")))
    return label_events(grouped.withColumn("N_EVENTS", F.size("EVENTS")))


def filter_by_activity(atoms: DataFrame, wanted: list[str], match: str = "any", col: str = "TRT_ACTIVITIES") -> DataFrame:
    """Zones whose set of activities meets (any) or holds (all) a list; a blank set goes."""
    if match not in ("any", "all"):
        raise ValueError("match is any or all")
    own = F.split(F.col(col), "\\|")
    hit = F.arrays_overlap(own, L.texts(wanted)) if match == "any" else F.size(F.array_except(L.texts(wanted), own)) == 0
    return atoms.where((F.col(col) != "") & hit)


def filter_by_year_range(atoms: DataFrame, start: int, end: int) -> DataFrame:
    """Zones whose window of years overlaps [start, end]; without years they go."""
    return atoms.where((F.col("FIRST_TRT_YEAR") <= end) & (F.col("LAST_TRT_YEAR") >= start))


def filter_complete(atoms: DataFrame, effect: str | None = None) -> DataFrame:
    return atoms.where("COMPLETE") if effect is None else atoms.where(F.col("COMPLETE") & (F.col("TRT_EFF") == effect))


def events_to_rows(atoms: DataFrame, events: str = "EVENTS", geometry: str | None = None) -> DataFrame:
    """One row per event with the zone's id and acres; zones without events vanish."""
    keep = ["ATOM_ID", "ACRES_GIS", *([geometry] if geometry else [])]
    return atoms.select(*keep, F.explode(events).alias("_e")).select(*keep, "_e.*")


def extract_field(atoms: DataFrame, field: str, name: str | None = None, delimiter: str = "|", events: str = "EVENTS") -> DataFrame:
    """Adds a column of the distinct values of an event field, sorted and joined; nothing but blanks: null."""
    values = F.transform(F.col(events), lambda e: e[field].cast("string"))
    shown = F.array_sort(F.array_distinct(F.filter(values, lambda v: F.coalesce(L.strip(v) != "", F.lit(False)))))
    return atoms.withColumn(name or field, F.when(F.size(shown) > 0, F.array_join(shown, delimiter)))


def to_json_events(events: Column) -> Column:
    """Event array as JSON text with its null fields."""
    return F.to_json(events, {"ignoreNullFields": "false"})


def from_json_events(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def to_variant_events(events: Column, is_text: bool = False) -> Column:
    """Events in either form, an array of structs or JSON text, as one VARIANT: parsed once, read by path afterwards. Null fields stay;
    null events, and text that is no JSON, are null."""
    return F.try_parse_json(events) if is_text else F.to_variant_object(events)


def from_variant_events(variant: Column, schema: str) -> Column:
    """The events of a VARIANT as an array of structs; fields it does not have are null, and what does not fit the schema is null."""
    return F.try_variant_get(variant, "$", schema)


def event_field(variant: Column, n: int, field: str, kind: str = "string") -> Column:
    """A field of the n-th event (from 0) of a VARIANT; null where there is none."""
    return F.try_variant_get(variant, f"$[{n}].{field}", kind)


def fill_year_bounds(atoms: DataFrame, events: str = "EVENTS") -> DataFrame:
    """FIRST_TRT_YEAR and LAST_TRT_YEAR from the events where they are missing."""
    years = F.transform(F.col(events), lambda e: e["YEAR_COMP"])
    for name, bound in (("FIRST_TRT_YEAR", F.array_min(years)), ("LAST_TRT_YEAR", F.array_max(years))):
        atoms = atoms.withColumn(name, F.coalesce(F.col(name), bound) if name in atoms.columns else bound)
    return atoms


def acres_by(rows: DataFrame, key: str, acres: str = "ACRES_GIS") -> DataFrame:
    """Acres by a key over rows, null keys left out."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.sum(acres), F.lit(0.0)).alias("acres"))


def years_by_activity(atoms: DataFrame, events: str = "EVENTS") -> DataFrame:
    """ATOM_ID, ACTIVITY, years (sorted distinct) of the events that count for labels."""
    rows = atoms.select("ATOM_ID", F.explode(L.labelled(F.col(events))).alias("e"))
    return rows.groupBy("ATOM_ID", F.col("e.ACTIVITY").alias("ACTIVITY")).agg(F.array_sort(F.collect_set("e.YEAR_COMP")).alias("years"))


def distinct_members(atoms: DataFrame, col: str) -> DataFrame:
    """Distinct members of a |-joined column."""
    return atoms.select(F.explode(F.split(F.col(col), "\\|")).alias("member")).where("member <> ''").distinct()


def profile(rows: DataFrame, cols: list[str], small: int = SMALL) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns, one row each: one aggregate over all columns, and one series of
    passes for all their quartiles, which are exact in bounded memory (see exact_quantiles). No values: null figures."""
    rows = settle(rows.select(*cols), "profile")
    x = {c: F.col(c).cast("double") for c in cols}
    own = lambda c: (F.lit(c).alias("column"), F.count(x[c]).alias("count"), F.avg(x[c]).alias("mean"), F.stddev_samp(x[c]).alias("std"), F.min(x[c]).alias("min"), F.max(x[c]).alias("max"))
    figures = rows.agg(F.array(*(F.struct(*own(c)) for c in cols)).alias("all")).select(F.inline("all"))
    quartiles = exact_quantiles(rows, x, (0.25, 0.5, 0.75), small=small).select(F.col("column").alias("_column"), *(F.get("quantiles", F.lit(n)).alias(name) for n, name in enumerate(("p25", "p50", "p75"))))
    out = figures.join(F.broadcast(quartiles), F.col("column") == F.col("_column"), "left")  # a row for each column
    return out.select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def first_atom(atoms: DataFrame, id_col: str = "ATOM_ID") -> DataFrame:
    """The row with the smallest id."""
    return atoms.orderBy(id_col).limit(1)
