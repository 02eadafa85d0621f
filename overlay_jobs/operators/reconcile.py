"""Cross-source reconciliation: event de-duplication inside a zone, coverage, and the audit of agreements and conflicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.functions import labels as L


@dataclass(frozen=True)
class Alias:
    """Activities that name the same treatment, and the one that a collapsed pair keeps."""

    members: tuple[str, ...]
    canonical: str


ALIASES = (Alias(("Pile Burn", "Broadcast Burn"), "Pile Burn"),)
BOTH = "CFT+TWIG"


def canonical(a: Column, b: Column, aliases: Sequence[Alias]) -> Column:
    """The label of an alias pair; null if the two are no such pair."""
    out = F.lit(None).cast("string")
    for rule in reversed(aliases or ()):
        out = F.when(a.isin(*rule.members) & b.isin(*rule.members) & (a != b), F.lit(rule.canonical)).otherwise(out)
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once: what a lambda refers to from outside is evaluated anew for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _class_of(label: Column, aliases: Sequence[Alias]) -> Column:
    """The label, or for one that aliases link to others the first of all that are linked: events of two classes never match."""
    groups: list[list[str]] = []
    for rule in aliases or ():
        linked = [g for g in groups if set(g) & set(rule.members)]
        groups = [g for g in groups if g not in linked] + [[*dict.fromkeys([m for g in linked for m in g] + list(rule.members))]]
    out = label
    for g in groups:
        out = F.when(label.isin(*g), F.lit(g[0])).otherwise(out)
    return out


def event_deduper(year_tol: int = 1, window: tuple[int, int] | None = None, aliases: Sequence[Alias] = ALIASES, authority: str = "CFT") -> Callable[[Column], Column]:
    """A function from event array to event array that collapses duplicates between the authority and other sources.

    Other events take their turns in list order. Each takes the authority's event that nobody took yet, of equal activity or an
    alias of it, whose year is nearest and not farther than year_tol (a missing year matches any, as the farthest); ties go to the
    first in the list. A taken event keeps its place with the alias's label, a reconciled year and SOURCE CFT+TWIG; the other goes.
    Null events give null. Run it once: collapsed events count as other ones.

    No join, no shuffle, no Python. The authority's events of a label and year wait in one queue in list order, and an event looks
    only at the heads of the queues of its label and its aliases: work is events times different labels and years, not events times
    events.
    """

    def queues(own: Column) -> Column:
        """own: events of a class in list order; label, year, their places, and who took the first of them."""
        keys = F.array_distinct(F.transform(own, lambda x: F.struct(x["label"].alias("label"), x["year"].alias("year"))))
        mine = lambda k: F.filter(own, lambda x: x["label"].eqNullSafe(k["label"]) & x["year"].eqNullSafe(k["year"]))
        return F.transform(keys, lambda k: F.struct(k["label"].alias("label"), k["year"].alias("year"), F.transform(mine(k), lambda x: x["i"]).alias("ids"), F.array().cast("array<int>").alias("takers")))

    def take(state: Column, other: Column) -> Column:
        head = lambda q: F.get(q["ids"], F.size(q["takers"]))
        gap = lambda q: F.abs(q["year"] - other["year"])

        def fits(q: Column) -> Column:
            same = q["label"].eqNullSafe(other["label"]) | canonical(q["label"], other["label"], aliases).isNotNull()
            return (F.size(q["takers"]) < F.size(q["ids"])) & same & F.coalesce(gap(q) <= year_tol, F.lit(True))

        best = F.array_min(F.transform(F.filter(state, fits), lambda q: F.struct(F.coalesce(gap(q), F.lit(99)).alias("d"), head(q).alias("i"))))["i"]
        longer = lambda q: q.withField("takers", F.array_append(q["takers"], other["i"]))
        return _let(best, lambda b: F.when(b.isNull(), state).otherwise(F.transform(state, lambda q: F.when(head(q) == b, longer(q)).otherwise(q))))

    def matches(rows: Column) -> Column:
        """rows: events of one class; (place of the authority's event, place of the one that took it)."""
        own, others = F.filter(rows, lambda x: x["own"]), F.filter(rows, lambda x: ~x["own"])
        ends = _let(own, lambda o: F.aggregate(others, queues(o), take))
        return F.flatten(F.transform(ends, lambda q: F.transform(q["takers"], lambda t, k: F.struct(F.get(q["ids"], k).alias("i"), t.alias("by")))))

    def marks(events: Column) -> Column:
        """For each event who took it: a place, -1 for nobody, -2 for one that took another."""
        own = lambda e: F.coalesce(e["SOURCE"] == authority, F.lit(False))
        slim = F.transform(events, lambda e, i: F.struct(_class_of(e["ACTIVITY"], aliases).alias("class"), e["ACTIVITY"].alias("label"), e["YEAR_COMP"].cast("int").alias("year"), i.alias("i"), own(e).alias("own")))
        classes = lambda rows: F.array_distinct(F.transform(rows, lambda x: x["class"]))
        pairs = _let(slim, lambda rows: F.flatten(F.transform(classes(rows), lambda c: _let(F.filter(rows, lambda x: x["class"].eqNullSafe(c)), matches))))

        def placed(p: Column) -> Column:
            took = F.transform(p, lambda x: x["by"])
            rest = F.array_except(F.transform(events, lambda e, i: i), F.concat(took, F.transform(p, lambda x: x["i"])))
            mark = lambda ids, by: F.transform(ids, lambda i: F.struct(i.alias("i"), F.lit(by).alias("by")))
            return F.transform(F.sort_array(F.concat(p, mark(took, -2), mark(rest, -1))), lambda x: x["by"])

        return _let(pairs, placed)

    def dedupe(events: Column) -> Column:
        def whole(evs: Column) -> Column:
            def finish(x: Column) -> Column:
                mate = F.get(evs, x["by"])
                mine, theirs = x["e"]["YEAR_COMP"], mate["YEAR_COMP"]
                year = F.coalesce(mine, theirs)
                if window is not None:
                    year = F.when(mine.isNull(), theirs).when(mine.between(*window), mine).otherwise(F.coalesce(theirs, mine))
                label = F.coalesce(canonical(x["e"]["ACTIVITY"], mate["ACTIVITY"], aliases), x["e"]["ACTIVITY"])
                return F.when(x["by"] >= 0, x["e"].withField("ACTIVITY", label).withField("YEAR_COMP", year).withField("SOURCE", F.lit(BOTH))).otherwise(x["e"])

            told = _let(marks(evs), lambda m: F.transform(evs, lambda e, i: F.struct(e.alias("e"), F.get(m, i).alias("by"))))
            return F.transform(F.filter(told, lambda x: x["by"] > -2), finish)

        return _let(events, whole)

    return dedupe


def source_coverage(frames: dict[str, DataFrame], year_col: str = "YEAR_COMP", agency_col: str = "AGENCY_C", acres_col: str = "GIS_ACRES", area: Callable[[Column], Column] | None = None) -> DataFrame:
    """Records, acres and agencies by source and year, missing years kept. Without acres, `area` of geometry counts, else nothing."""
    parts = None
    for name, df in frames.items():
        source = F.col("SOURCE") if "SOURCE" in df.columns else F.lit(name)
        acres = F.col(acres_col) if acres_col in df.columns else (area(F.col("geometry")) * L.M2_TO_ACRES if area is not None and "geometry" in df.columns else F.lit(None))
        agency = F.col(agency_col) if agency_col in df.columns else F.lit(None)
        own = df.select(source.cast("string").alias("SOURCE"), F.col(year_col).cast("int").alias("YEAR_COMP"), acres.cast("double").alias("acres"), agency.cast("string").alias("agency"))
        parts = own if parts is None else parts.unionByName(own)
    if parts is None:
        raise ValueError("no source given")
    return _coverage(parts)


def event_coverage(atoms: DataFrame, events: str = "EVENTS", acres_col: str = "ACRES_GIS") -> DataFrame:
    """The same from zones: every event counts once and carries its zone's acres; zones without events vanish."""
    rows = atoms.select(F.col(acres_col).cast("double").alias("acres"), F.explode(events).alias("e"))
    return _coverage(rows.select("acres", F.col("e.SOURCE").alias("SOURCE"), F.col("e.YEAR_COMP").alias("YEAR_COMP"), F.col("e.AGENCY_C").alias("agency")))


def _coverage(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("SOURCE", "YEAR_COMP").agg(F.count("*").alias("n_records"), F.coalesce(F.sum("acres"), F.lit(0.0)).alias("acres"), F.concat_ws("|", F.array_sort(F.collect_set("agency"))).alias("agencies"))
    return out.orderBy(F.col("SOURCE").asc_nulls_last(), F.col("YEAR_COMP").asc_nulls_last())


def audit(atoms: DataFrame, events: str = "EVENTS", acres_col: str = "ACRES_GIS", year_tol: int = 1, aliases: Sequence[Alias] = ALIASES) -> DataFrame:
    """One row per zone: ATOM_ID, ACRES, CLASS, CFT_ACTS, TWIG_ACTS, CFT_YEARS, TWIG_YEARS. Row by row, no shuffle."""

    def of(source: str, field: str) -> Column:
        own = F.filter(F.col(events), lambda e: e["SOURCE"].isin(source, BOTH) & e[field].isNotNull())
        return F.array_sort(F.array_distinct(F.transform(own, lambda e: e[field])))

    sources = F.array_distinct(F.transform(F.col(events), lambda e: F.coalesce(e["SOURCE"], F.lit(""))))
    rows = atoms.select("ATOM_ID", F.col(acres_col).alias("ACRES"), sources.alias("s"), *(of(s, f).alias(f"{s}_{n}") for s in ("CFT", "TWIG") for n, f in (("a", "ACTIVITY"), ("y", "YEAR_COMP"))))
    cft, twig = (F.array_contains("s", x) | F.array_contains("s", BOTH) for x in ("CFT", "TWIG"))
    close = F.exists("CFT_y", lambda a: F.exists("TWIG_y", lambda b: F.abs(a - b) <= year_tol))
    alias = F.exists("CFT_a", lambda a: F.exists("TWIG_a", lambda b: canonical(a, b, aliases).isNotNull()))
    kind = (
        F.when(~(cft & twig), F.when(cft, F.lit("CFT_ONLY")).otherwise(F.lit("TWIG_ONLY")))
        .when(F.array_contains("s", BOTH) & (F.size("s") == 1), F.lit("AGREE"))
        .when(F.arrays_overlap("CFT_a", "TWIG_a"), F.when((F.size("CFT_y") == 0) | (F.size("TWIG_y") == 0) | close, F.lit("AGREE")).otherwise(F.lit("YEAR_CONFLICT")))
        .when(alias, F.lit("ALIAS"))
        .otherwise(F.lit("TYPE_CONFLICT"))
    )
    shown = {f"{s}_{n}": F.concat_ws("|", F.col(f"{s}_{k}").cast("array<string>")) for s in ("CFT", "TWIG") for n, k in (("ACTS", "a"), ("YEARS", "y"))}
    return rows.select("ATOM_ID", "ACRES", kind.alias("CLASS"), *(shown[n].alias(n) for n in ("CFT_ACTS", "TWIG_ACTS", "CFT_YEARS", "TWIG_YEARS")))


def audit_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("CLASS").agg(F.count("*").alias("atoms"), F.coalesce(F.sum("ACRES"), F.lit(0.0)).alias("acres"))
