"""Labels of a zone from its event array, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.column import Column

M2_TO_ACRES = 0.000247105
MIN_AREA_M2 = 900.0

EVENT_FIELDS = ("ACTIVITY", "YEAR_COMP", "AGENCY_C", "FUND_SOURCE", "FUND_TYPE", "PARTNERS", "LANDOWNER", "MGT_TYPE")

# Treatment types by rank of effect, thinning and burning types, management groups.
PRIORITY = (
    ("Mechanical", "Broadcast Burn"),
    ("Manual", "Broadcast Burn"),
    ("Broadcast Burn",),
    ("Mechanical",),
    ("Manual",),
    ("Mastication",),
    ("Removal",),
    ("Pile Burn",),
    ("Pile Fuels",),
    ("Chipping",),
    ("Mulching",),
    ("Lop and Scatter",),
)
THIN_TYPES = ("Manual", "Mechanical")
BURN_TYPES = ("Broadcast Burn",)
GROUPS = {
    "CANOPY": ("Manual", "Mechanical", "Mastication", "Broadcast Burn"),
    "SURFACE": ("Pile Fuels", "Removal", "Lop and Scatter", "Mulching", "Pile Burn", "Broadcast Burn"),
}
SINGLES = tuple(p[0] for p in PRIORITY if len(p) == 1)


def strip(c: Column) -> Column:
    """Without white space at either end, of any Unicode kind."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def texts(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def pipe_set(values: Column) -> Column:
    """Sorted distinct stripped values that are not blank, joined by |; none: empty text."""
    return F.concat_ws("|", F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: strip(v.cast("string"))), lambda v: F.coalesce(v != "", F.lit(False))))))


def labelled(events: Column) -> Column:
    """Events that count for labels: with an activity and a year."""
    return F.filter(events, lambda e: F.coalesce(e["ACTIVITY"] != "", F.lit(False)) & e["YEAR_COMP"].isNotNull())


def activities(counted: Column) -> Column:
    return F.array_distinct(F.transform(counted, lambda e: e["ACTIVITY"]))


def effect(present: Column) -> Column:
    """The first satisfied combination of the priority list; else all types, sorted; none: Unknown."""
    first = F.coalesce(*(F.when(reduce(lambda a, b: a & b, (F.array_contains(present, t) for t in combo)), F.lit(" + ".join(combo))) for combo in PRIORITY))
    return F.when(F.size(present) == 0, F.lit("Unknown")).otherwise(F.coalesce(first, F.concat_ws(" + ", F.array_sort(present))))


def ordered_set(present: Column) -> Column:
    """Types in the order of priority, then the others sorted."""
    return F.concat(F.filter(texts(SINGLES), lambda t: F.array_contains(present, t)), F.array_sort(F.array_except(present, texts(SINGLES))))


def type_at(counted: Column, year: Column) -> Column:
    """The best single type among those at a year; null without one."""
    there = F.array_distinct(F.transform(F.filter(counted, lambda e: e["YEAR_COMP"] == year), lambda e: e["ACTIVITY"]))
    return F.get(ordered_set(there), F.lit(0))


def any_of(present: Column, types: tuple[str, ...]) -> Column:
    return F.arrays_overlap(present, texts(types))


def group_members(present: Column, types: tuple[str, ...]) -> Column:
    """Sorted members of a management group joined by |; none: null."""
    both = F.array_sort(F.array_intersect(present, texts(types)))
    return F.when(F.size(both) > 0, F.concat_ws("|", both))


def years_of(counted: Column, types: tuple[str, ...]) -> Column:
    return F.transform(F.filter(counted, lambda e: e["ACTIVITY"].isin(*types)), lambda e: e["YEAR_COMP"])


# Activities in the order in which charts show them.
ACTIVITY_ORDER = ("Mechanical", "Manual", "Mastication", "Removal", "Pile Burn", "Pile Fuels", "Chipping", "Mulching", "Lop and Scatter", "Broadcast Burn", "Prescribed Burn (Range)", "Fire Use")


def activity_rank(activity: Column) -> Column:
    """Place of an activity in ACTIVITY_ORDER, from 1; all others and null come after them, as one category."""
    at = F.array_position(F.array(*map(F.lit, ACTIVITY_ORDER)), F.coalesce(activity, F.lit("")))
    return F.when(at > 0, at).otherwise(len(ACTIVITY_ORDER) + 1).cast("int")


def activity_category(activity: Column) -> Column:
    """The activity itself if it has a place of its own, else Other."""
    return F.when(activity.isin(*ACTIVITY_ORDER), activity).otherwise("Other")
