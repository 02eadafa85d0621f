"""Descriptors through the crosswalk, QA filters, schema mapping."""

import pytest
from pyspark.sql import functions as F

from overlay_jobs.operators import harmonize as H
from overlay_jobs.sources.crosswalk import ROWS, SCHEMA, default_crosswalk
from overlay_jobs.sources.tables import check_crosswalk, load_crosswalk

COLS = "n int, activity string, type string, method string, twig_category string, category string, equipment string, acres double"
CASES = [
    (("Stand Clearcut (EA/RH/FH)", "Biomass Removal", None, None, "Mechanical", None), "Mechanical", "activity", "resolved"),
    (("Site Preparation for Planting - Mechanical", None, "Mechanical", None, None, "Dozer"), "Mechanical", "activity", "resolved"),
    (("Burning of Piled Material", "Machine Pile Burn", "Prescribed Burn", None, None, None), "Pile Burn", "activity", "resolved"),
    ((None, "Thinning", None, None, None, "Feller Buncher"), "Mechanical", "type", "resolved"),
    ((None, "Thinning", None, None, None, "Chain Saw"), "Manual", "type", "resolved"),
    ((None, "Chemical", None, None, None, None), None, "type", "dropped"),
    ((None, "not in there", None, None, None, None), None, None, "quarantined"),
    (("Wildland Fire Use", None, "Fire", "Unplanned Ignition", None, None), "Fire Use", "activity", "resolved"),
    (("Wildfire - Fuels Benefit", None, "Wildfire", None, None, None), "Fire Use", "activity", "resolved"),
    ((None, None, "Prescribed Burn", None, "Unplanned Ignition", None), "Broadcast Burn", "method", "resolved"),
    ((None, None, "Prescribed Burn", "Unplanned Ignition", None, None), None, "wildfire", "dropped"),
    ((None, None, "Prescribed Burn", "Planned Ignition", None, None), "Broadcast Burn", "method", "resolved"),
    (("Range Cover Manipulation", None, "Prescribed Burn", None, None, None), "Prescribed Burn (Range)", "activity", "resolved"),
    (("Range Cover Manipulation", None, "Tractor Logging", None, None, None), None, "activity", "dropped"),
    (("Tree Release and Weed", None, "Chemical", None, None, None), None, "activity", "dropped"),
    (("Tree Release and Weed", None, "Mechanical", None, None, None), "Mastication", "activity", "resolved"),
    (("Tree Release and Weed", None, "Fire", None, None, None), None, "activity", "quarantined"),
    (("Tree Release and Weed", "Thinning", None, None, None, "Chain Saw"), "Manual", "activity", "resolved"),
    (("", " ", "n/a", "NA", None, None), None, None, "quarantined"),
    ((None, "thinning", None, None, None, None), None, None, "quarantined"),
]


def test_resolution(spark):
    rows = [(n, *case, 10.0) for n, (case, *_) in enumerate(CASES)]
    out = {r["n"]: r for r in H.harmonize_activity(spark.createDataFrame(rows, COLS), default_crosswalk(spark)).collect()}
    for n, (_, activity, field, status) in enumerate(CASES):
        assert (out[n]["ACTIVITY"], out[n]["ACTIVITY_FIELD"], out[n]["ACTIVITY_STATUS"]) == (activity, field, status), CASES[n]
    assert sum(r["RAN_CLASSIFY_THIN"] for r in out.values()) == 2
    assert {r["ACRES_REPORTED"] for r in out.values()} == {10.0}


def test_thin_classifier_of_ones_own(spark):
    """Another classifier decides for thinning, and for release with thinning; where it has no answer the default stays."""
    rows = [(n, *case, 10.0) for n, case in enumerate([(None, "Thinning", None, None, None, "Chain Saw"), (None, "Thinning", None, None, None, "Feller Buncher"), ("Tree Release and Weed", "Thinning", None, None, None, "Chain Saw"), (None, "Mastication", None, None, None, "Chain Saw")])]
    own = lambda get: F.when(F.lower(get("equipment")) == "chain saw", F.lit("Lop and Scatter"))
    out = H.harmonize_activity(spark.createDataFrame(rows, COLS), default_crosswalk(spark), own).orderBy("n").collect()
    assert [r["ACTIVITY"] for r in out] == ["Lop and Scatter", "Mechanical", "Lop and Scatter", "Mastication"]


def test_summary_shows_zeros(spark):
    own = H.harmonize_activity(spark.createDataFrame([(1, None, "Mastication", None, None, None, None, 3.0)], COLS), default_crosswalk(spark))
    assert [(r["ACTIVITY_STATUS"], r["records"]) for r in H.harmonize_summary(own).collect()] == [("resolved", 1), ("dropped", 0), ("quarantined", 0)]


def test_crosswalk(spark, tmp_path):
    assert {r[3] for r in ROWS} <= {"canopy", "surface", "none"} and {r[4] for r in ROWS} <= {"high", "medium", "low"}
    check_crosswalk(default_crosswalk(spark))
    with pytest.raises(ValueError):
        check_crosswalk(spark.createDataFrame([*ROWS, ROWS[0]], SCHEMA))
    path = tmp_path / "x.csv"
    path.write_text('field,value,activity,effect,confidence\ntype," Pile, big ",Pile Burn,surface,high\n')
    assert tuple(load_crosswalk(spark, str(path)).head()) == ("type", "Pile, big", "Pile Burn", "surface", "high")


def test_qa_filter(spark):
    rows = [(1, "Completed", None, "2020-05-01"), (2, "Completed", "DUPLICATE_DROP", "2020-05-01"), (3, None, None, "2020-05-01"), (4, "Completed", "other", "no date"), (5, "Completed", None, "2011-01-01")]
    df = spark.createDataFrame(rows, "id int, status string, error string, treatment_date string")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(H.qa_filter(df)) == [1, 4, 5]
    assert ids(H.qa_filter(df, statuses=(), drop_errors=())) == [1, 2, 3, 4, 5]
    assert ids(H.qa_filter(df, year_start=2015)) == [1]


def test_event_schema(spark):
    df = spark.createDataFrame([(1, "Manual", "BIL", "USFS", 2020), (2, "Manual", "xyz", None, None)], "n long, ACTIVITY string, fund_source string, agency string, year_comp int")
    out = H.to_event_schema(df, "n", id_offset=100).orderBy("OBJECTID").collect()
    assert [r["OBJECTID"] for r in out] == [101, 102] and out[0]["FUND_SOURCE"] == "Bipartisan\xa0Infrastructure Law\xa0(BIL)" and out[1]["FUND_SOURCE"] == "xyz"
    assert out[0]["AGENCY_C"] == "USFS" and out[0]["YEAR_COMP"] == 2020 and out[0]["SOURCE"] == "TWIG" and out[0]["PARTNERS"] is None
    with pytest.raises(ValueError):
        H.to_event_schema(df.withColumn("ACTIVITY", F.lit(None).cast("string")), "n")
    with pytest.raises(ValueError):
        H.to_event_schema(df.drop("ACTIVITY"), "n")


def test_years_are_in_utc_whatever_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/Denver", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            ms = 1_735_689_600_000  # 2025-01-01T00:00Z
            for kind in ("bigint", "double", "decimal(20,0)"):
                df = spark.sql(f"SELECT CAST({ms} AS {kind}) AS treatment_date UNION ALL SELECT CAST({ms - 1} AS {kind})")
                assert sorted(r[0] for r in df.select(H.completion_year(df)).collect()) == [2024, 2025]
            text = spark.createDataFrame([("2025-01-01",), ("2025-01-01T00:00:00Z",), ("2024-12-31 23:30:00-01:00",), ("2025-01-01 00:30:00",), ("nothing",), (None,)], "treatment_date string")
            assert [r[0] for r in text.select(H.completion_year(text)).collect()] == [2025, 2025, 2025, 2025, None, None]
            own = spark.sql(f"SELECT timestamp_millis({ms}) AS treatment_date")
            assert own.select(H.completion_year(own)).head()[0] == 2025
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
