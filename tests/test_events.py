"""Labels, de-duplication, coverage, audit, filters."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlay_jobs.operators import atoms as A
from overlay_jobs.operators import reconcile as R

EVENT = "array<struct<SOURCE_ID: bigint, ACTIVITY: string, YEAR_COMP: int, AGENCY_C: string, FUND_SOURCE: string, SOURCE: string>>"


def zones(spark, lists):
    rows = [(n, float(n + 1), [(i, *e[:2], None, None, e[2]) for i, e in enumerate(own)]) for n, own in enumerate(lists)]
    return spark.createDataFrame(rows, f"ATOM_ID long, ACRES_GIS double, EVENTS {EVENT}")


def plain_dedupe(events, tol=1, window=None):
    """The rules, event by event."""
    alias = lambda a, b: a != b and {a, b} == {"Pile Burn", "Broadcast Burn"}
    evs, used, gone = [list(e) for e in events], set(), set()
    for j, e in enumerate(events):
        if e[2] == "CFT":
            continue
        fits = []
        for i, c in enumerate(evs):
            if c[2] == "CFT" and i not in used and (c[0] == e[0] or alias(c[0], e[0])) and (c[1] is None or e[1] is None or abs(c[1] - e[1]) <= tol):
                fits.append((99 if c[1] is None or e[1] is None else abs(c[1] - e[1]), i))
        if fits:
            i = min(fits)[1]
            used.add(i)
            gone.add(j)
            c = evs[i]
            year = e[1] if c[1] is None else c[1] if window is None or window[0] <= c[1] <= window[1] or e[1] is None else e[1]
            c[:] = ["Pile Burn" if alias(c[0], e[0]) else c[0], year, "done"]
    return [("CFT+TWIG" if e[2] == "done" else e[2], e[0], e[1]) for k, e in enumerate(evs) if k not in gone]


@pytest.mark.parametrize("window", [None, (2014, 2024)])
def test_dedupe_against_rules(spark, window):
    rng = random.Random(5)
    acts = ["Manual", "Pile Burn", "Broadcast Burn", None]
    lists = [[(rng.choice(acts), rng.choice([2012, 2013, 2014, 2015, None]), rng.choice(["CFT", "TWIG", None])) for _ in range(rng.randrange(9))] for _ in range(150)]
    lists += [[("Manual", 2024, "CFT"), ("Manual", 2024, "TWIG")], [("Broadcast Burn", 2017, "CFT"), ("Broadcast Burn", 2022, "TWIG")], [("Pile Burn", 2020, "CFT"), ("Broadcast Burn", 2020, "TWIG")], [("Manual", 2013, "CFT"), ("Manual", 2014, "TWIG")], []]
    out = zones(spark, lists).withColumn("d", R.event_deduper(window=window)("EVENTS")).orderBy("ATOM_ID").collect()
    for own, r in zip(lists, out):
        assert [(e["SOURCE"], e["ACTIVITY"], e["YEAR_COMP"]) for e in r["d"]] == plain_dedupe(own, window=window), own


def quick_dedupe(events, tol=1):
    """The rules without a window, each event against all others at once."""
    code = {"Pile Burn": 0, "Broadcast Burn": 0}
    code |= {a: n + 1 for n, a in enumerate(sorted({str(e[0]) for e in events} - set(code)))}
    own = np.array([i for i, e in enumerate(events) if e[2] == "CFT"])
    label = np.array([code[str(events[i][0])] for i in own])
    year = np.array([np.nan if events[i][1] is None else events[i][1] for i in own])
    free, mates = np.ones(len(own), bool), {}
    for j, (act, y, source) in enumerate(events):
        if source != "CFT":
            gap = np.abs(year - (np.nan if y is None else y))
            far = np.where(np.isnan(gap), 99, gap)
            fit = np.flatnonzero(free & (label == code[str(act)]) & ((gap <= tol) | np.isnan(gap)))
            if len(fit):
                at = fit[np.argmin(far[fit])]
                free[at] = False
                mates[int(own[at])] = j
    out, gone = [], set(mates.values())
    for i, e in enumerate(events):
        mate = events[mates[i]] if i in mates else None
        if mate:
            out.append(("CFT+TWIG", e[0] if e[0] == mate[0] else "Pile Burn", mate[1] if e[1] is None else e[1]))
        elif i not in gone:
            out.append((e[2], e[0], e[1]))
    return out


def test_dedupe_of_a_hot_zone(spark):
    rng = random.Random(6)
    acts = ["Manual", "Pile Burn", "Broadcast Burn", None, *(f"a{n}" for n in range(20))]
    make = lambda n, years: [(rng.choice(acts), rng.choice(years), rng.choice(["CFT", "TWIG", None])) for _ in range(n)]
    lists = [make(300, [2012, 2013, None]), make(50_000, [None, *range(1980, 2025)]), [("Manual", 2020, s) for s in ("CFT", "TWIG") for _ in range(2_000)], make(3, [2020])]
    assert quick_dedupe(lists[0]) == plain_dedupe(lists[0])
    began = time.time()
    out = zones(spark, lists).withColumn("d", R.event_deduper()("EVENTS")).orderBy("ATOM_ID").collect()
    assert time.time() - began < 120
    for own, r in zip(lists, out):
        assert [(e["SOURCE"], e["ACTIVITY"], e["YEAR_COMP"]) for e in r["d"]] == quick_dedupe(own)


def test_dedupe_of_nothing(spark):
    z = zones(spark, [[], [("Manual", 2020, "TWIG")], [("Manual", 2020, "CFT")]]).withColumn("EVENTS", F.when(F.col("ATOM_ID") > 0, F.col("EVENTS")))
    z = z.unionByName(zones(spark, [[]]).withColumn("ATOM_ID", F.lit(9).cast("long")))
    out = {r[0]: r[1] for r in z.select("ATOM_ID", R.event_deduper()("EVENTS")).collect()}
    assert out[0] is None and out[9] == [] and len(out[1]) == len(out[2]) == 1


def test_linked_aliases(spark):
    """Two rules that share a label: equal neighbours match, the ends of the chain do not."""
    rules = (R.Alias(("a", "b"), "a"), R.Alias(("b", "c"), "c"))
    lists = [[("a", 2020, "CFT"), ("b", 2020, "TWIG")], [("b", 2020, "CFT"), ("c", 2020, "TWIG")], [("a", 2020, "CFT"), ("c", 2020, "TWIG")]]
    out = zones(spark, lists).withColumn("d", R.event_deduper(aliases=rules)("EVENTS")).orderBy("ATOM_ID").collect()
    assert [[e["ACTIVITY"] for e in r["d"]] for r in out] == [["a"], ["c"], ["a", "c"]]


def test_aliases_can_be_off(spark):
    z = zones(spark, [[("Pile Burn", 2020, "CFT"), ("Broadcast Burn", 2020, "TWIG")]])
    assert z.select(F.size(R.event_deduper(aliases=())("EVENTS"))).head()[0] == 2


def test_audit_classes(spark):
    lists = [
        [("Manual", 2020, "CFT+TWIG")], [("Manual", 2020, "CFT"), ("Mastication", 2020, "TWIG")], [("Manual", 2020, "TWIG")],
        [("Manual", 2015, "CFT"), ("Manual", 2020, "TWIG")], [("Pile Burn", 2020, "CFT"), ("Broadcast Burn", 2020, "TWIG")], [("Manual", 2020, "CFT")], [],
    ]
    out = R.audit(zones(spark, lists)).orderBy("ATOM_ID").collect()
    assert [r["CLASS"] for r in out] == ["AGREE", "TYPE_CONFLICT", "TWIG_ONLY", "YEAR_CONFLICT", "ALIAS", "CFT_ONLY", "TWIG_ONLY"]
    assert out[3]["CFT_YEARS"] == "2015" and out[6]["CFT_ACTS"] == ""


def test_labels(spark):
    lists = [[("Manual", 2012, "CFT"), ("Broadcast Burn", 2010, "CFT")], [("Seeding", 2011, "CFT"), ("Chipping", 2011, "CFT")], [(None, 2011, "CFT"), ("Manual", None, "CFT")], [("Mechanical", 2015, "CFT"), ("Manual", 2016, "CFT")]]
    a, b, c, d = A.label_events(zones(spark, lists)).orderBy("ATOM_ID").collect()
    assert (a["TRT_EFF"], a["TRT_SET"], a["COMPLETE"], a["FIRST_TRT"], a["LAST_TRT"], a["LAST_THIN"], a["CANOPY"]) == ("Manual + Broadcast Burn", "Broadcast Burn + Manual", True, "Broadcast Burn", "Manual", None, "Broadcast Burn|Manual")
    assert (b["TRT_EFF"], b["TRT_ACTIVITIES"], b["CANOPY"], b["SURFACE"], b["AGENCIES"]) == ("Chipping", "Chipping|Seeding", None, None, "")
    assert (c["TRT_EFF"], c["TRT_ACTIVITIES"], c["FIRST_TRT"], c["FIRST_TRT_YEAR"], c["COMPLETE"]) == ("Unknown", "Unknown", None, 2011, False)
    assert (d["TRT_EFF"], d["LAST_THIN"]) == ("Mechanical", 2016)
    assert [r["COMPLETE"] for r in A.label_events(zones(spark, lists[:1]), ordered=True).collect()] == [False]


def test_flat_views_and_filters(spark):
    z = A.label_events(zones(spark, [[("Manual", 2012, "CFT"), ("Removal", 2014, "CFT")], [], [("Manual", 2016, "CFT")]]))
    assert A.events_to_rows(z).count() == 3
    ids = lambda d: sorted(r["ATOM_ID"] for r in d.collect())
    assert ids(A.filter_by_activity(z, ["Removal", "Manual"])) == [0, 2] and ids(A.filter_by_activity(z, ["Removal", "Manual"], "all")) == [0]
    assert ids(A.filter_by_activity(z, [], "all")) == [0, 1, 2] and ids(A.filter_by_activity(z, [])) == []
    assert ids(A.filter_by_year_range(z, 2013, 2013)) == [0] and ids(A.filter_complete(z)) == []
    assert [r["x"] for r in A.extract_field(z, "ACTIVITY", "x").orderBy("ATOM_ID").collect()] == ["Manual|Removal", None, "Manual"]


def test_coverage(spark):
    z = zones(spark, [[("Manual", 2012, "CFT"), ("Manual", 2012, "CFT"), ("Manual", None, "TWIG")], []])
    assert [tuple(r) for r in R.event_coverage(z).collect()] == [("CFT", 2012, 2, 2.0, ""), ("TWIG", None, 1, 1.0, "")]
    with pytest.raises(ValueError):
        R.source_coverage({})


def test_quantiles_by_refined_histograms(spark):
    import random

    from pyspark.sql import functions as F

    from overlay_jobs.operators.quantiles import exact_quantile

    rng = random.Random(6)
    rows = [(g, x) for g in ("a", "b", None) for x in [rng.choice([rng.gauss(0, 1), 3.5, rng.uniform(-1e12, 1e12), 1e-9 * rng.random()]) for _ in range(rng.choice([1, 150, 401]))]] + [("c", 7.0)] * 50 + [("d", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        got, want = ({r["group"]: r["quantile"] for r in exact_quantile(df, F.col("v"), q, F.col("g"), small).collect()} for small in (0, 10**6))
        assert set(got) == set(want) == {"a", "b", "c", None}
        assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)


def test_events_as_variants(spark):
    """Both forms give the same events; missing fields, nulls and text that is no JSON are nulls, not errors."""
    kind = "array<struct<ACTIVITY:string,YEAR_COMP:int>>"
    events = [("Removal", 2010), (None, None), ('say "é"', 1999)]
    df = spark.createDataFrame([(0, events, None), (1, None, '[{"ACTIVITY": "Removal"}, {"YEAR_COMP": 3}]'), (2, None, "no json"), (3, [], "[]"), (4, None, "")], f"n long, e {kind}, t string")
    v = df.select("n", A.to_variant_events(F.col("e")).alias("a"), A.to_variant_events(A.to_json_events(F.col("e")), is_text=True).alias("b"), A.to_variant_events(F.col("t"), is_text=True).alias("c"))
    rows = v.select("n", *(A.from_variant_events(F.col(c), kind).alias(c) for c in "abc"), A.event_field(F.col("a"), 2, "YEAR_COMP", "int").alias("y"), A.event_field(F.col("a"), 9, "YEAR_COMP", "int").alias("none")).orderBy("n").collect()
    assert [tuple(e) for e in rows[0]["a"]] == [tuple(e) for e in rows[0]["b"]] == events and (rows[0]["y"], rows[0]["none"]) == (1999, None)
    assert [tuple(e) for e in rows[1]["c"]] == [("Removal", None), (None, 3)] and rows[1]["a"] is None
    assert rows[2]["c"] is None and rows[4]["c"] is None and rows[3]["a"] == rows[3]["c"] == []


def test_many_quantiles_in_one_series_of_passes(spark, monkeypatch):
    """All ranks of all columns and groups together: no more passes than the slowest of them needs alone."""
    from overlay_jobs.operators import quantiles as Q

    rng = random.Random(8)
    inf = float("inf")
    wild = [inf, -inf, 5e-324, 0.0, -0.0, 1.7e308, -1.7e308, float("nan"), None]
    rows = [(rng.choice(["a", "b", None]), rng.lognormvariate(0, 9), rng.choice([1.0, 2.0, 2.0 + 2**-51, None])) for _ in range(4000)]
    rows += [("wild", rng.choice(wild), None) for _ in range(200)] + [("one", 7.0, inf), ("tiny", 0.0, 1.0), ("tiny", 5e-324, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3).cache()
    passes = []
    kept = Q.settle
    monkeypatch.setattr(Q, "settle", lambda d, name: (passes.append(name), kept(d, name))[1])

    def run(cols, qs, small=0):
        del passes[:]
        out = {(r["column"], r["group"]): r["quantiles"] for r in Q.exact_quantiles(df, {c: F.col(c) for c in cols}, qs, F.col("g"), small).collect()}
        return out, passes.count("quantile-cells")

    qs = (0.5, 0.0, 1.0, 0.25, 0.333, 0.99, 0.5)
    got, together = run("xy", qs)
    want, none = run("xy", qs, 10**6)
    assert none == 0 and set(got) == set(want) and ("y", "wild") not in got
    for key, values in want.items():
        assert [repr(v) for v in got[key]] == [repr(v) for v in values] or got[key] == pytest.approx(values, rel=1e-12, nan_ok=True), key
    assert together <= max(run(c, (q,))[1] for c in "xy" for q in set(qs))
    with pytest.raises(ValueError):
        Q.exact_quantiles(df, {"x": F.col("x")}, (1.5,))


def test_profile_of_large_and_empty_tables(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.gauss(0, 5), rng.randrange(9), None) for _ in range(2000)] + [(None, None, None)], "a double, b int, c double")
    large, usual = ({r["column"]: r.asDict() for r in A.profile(df, ["a", "b", "c"], small).collect()} for small in (0, 10**6))
    assert large == usual and list(large["c"].values()) == ["c", 0, None, None, None, None, None, None, None]
    assert [r["count"] for r in A.profile(df.limit(0), ["a", "b"]).collect()] == [0, 0]
