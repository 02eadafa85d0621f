"""The driver's tables in the shape of treatments, zones with events, boxes on a lattice, and descriptor records.

Only whole-number arithmetic, so that any SQL engine makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlay_jobs.functions import geom as G

ACTIVITIES = ("Manual", "Mechanical", "Broadcast Burn", "Mastication", "Removal", "Pile Burn", "Pile Fuels", "Chipping", "Mulching", "Lop and Scatter", "Fire Use", "Seeding", None)
CELL = 30
#: Descriptor records: activity, type, method, twig_category, category, equipment.
DESCRIPTORS = (
    ("Commercial Thin", "Thinning", "Mechanical", "Mechanical", None, "Feller Buncher"),
    ("Precommercial Thin", None, "Manual", None, None, None),
    ("Stand Clearcut (EA/RH/FH)", "Biomass Removal", None, "Mechanical", "Mechanical", None),
    ("Site Preparation for Planting - Mechanical", None, "Mechanical", None, None, "Dozer"),
    ("Burning of Piled Material", "Machine Pile Burn", "Prescribed Burn", None, None, None),
    (None, "Thinning", None, None, None, "Chain Saw"),
    (None, "Chemical", None, None, None, None),
    (None, "no such type", None, None, None, None),
    ("  ", "n/a", "NA", "None", None, None),
    ("Wildland Fire Use", None, "Fire", "Unplanned Ignition", None, None),
    ("Wildfire - Fuels Benefit", None, "Wildfire", None, None, None),
    (None, None, "Prescribed Burn", "Unplanned Ignition", None, None),
    (None, None, "Prescribed Burn", "Planned Ignition", None, None),
    ("Range Cover Manipulation", None, "Prescribed Burn", None, None, None),
    ("Range Cover Manipulation", None, "Tractor Logging", None, None, None),
    ("Tree Release and Weed", None, "Chemical", None, None, None),
    ("Tree Release and Weed", None, "Mechanical", None, None, None),
    ("Tree Release and Weed", None, "Fire", None, None, None),
    ("Tree Release and Weed", "Thinning", None, None, None, "Chain Saw"),
    ("Tree Release and Weed", None, "Power Hand", None, None, None),
    (None, "Mastication", None, None, None, None),
    (" Fuel Break ", "Mowing", None, None, None, None),
    (None, "mastication", None, None, None, None),
    (None, None, "Wildfire", None, "Wildfire Non-Treatment", None),
    (None, None, None, "Mechanical", None, None),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def treatments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("o_orderkey")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    slot = ((k * 7 + F.col("o_custkey")) % len(ACTIVITIES)).cast("int")
    return joined.select(
        k.cast("long").alias("OBJECTID"),
        F.when(k % 3 == 0, "TWIG").otherwise("CFT").alias("SOURCE"),
        F.get(F.array(*map(F.lit, ACTIVITIES)), slot).alias("ACTIVITY"),
        F.when(k % 17 != 0, F.year("o_orderdate") + 15).cast("int").alias("YEAR_COMP"),
        F.when(k % 19 == 0, F.lit(None)).when(k % 11 == 0, F.concat(F.lit("  "), F.col("n_name"))).otherwise(F.col("n_name")).alias("AGENCY_C"),
        F.col("c_mktsegment").alias("FUND_SOURCE"),
        F.col("o_orderpriority").alias("FUND_TYPE"),
        F.col("o_orderstatus").alias("LANDOWNER"),
        (F.col("o_totalprice") / 1000).alias("ACRES_GIS"),
        F.col("o_custkey").cast("long").alias("ZONE"),
    )


def flag_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatments with ACRES_MGT (some missing) and gis_acres."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("ACRES_MGT"))
    own = treatments(spark, sf_dir).join(lines, F.col("OBJECTID") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return own.withColumn("gis_acres", F.col("ACRES_GIS"))


def zones(spark: SparkSession, sf_dir: str, dedupe=None) -> DataFrame:  # noqa: ANN001
    """One zone per customer with its orders as events; half an acre more for each step of the key modulo 97."""
    from overlay_jobs.operators.atoms import aggregate_events

    t = treatments(spark, sf_dir)
    own = aggregate_events(t.select(F.col("ZONE").alias("ATOM_ID"), "OBJECTID"), t, "ATOM_ID", "OBJECTID", ("SOURCE",), dedupe)
    return own.withColumn("ACRES_GIS", (F.col("ATOM_ID") % 97 + 1) * F.lit(0.5))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 1 to 6 cells a side on a lattice of 30 m cells, with treatment attributes."""
    k, c = F.col("OBJECTID"), F.col("ZONE")
    div = lambda a, b: F.floor(a / b).cast("long")
    gx, gy = div(c, 100) % 64 * 64 + (k * 37) % 64, div(c, 6400) * 64 + (k * 53 + c * 11) % 64
    own = treatments(spark, sf_dir).withColumns({"gx": gx, "gy": gy, "w": 1 + k % 6, "h": 1 + div(k, 7) % 6})
    return own.withColumn("geometry", G.box(F.col("gx") * CELL, F.col("gy") * CELL, (F.col("gx") + F.col("w")) * CELL, (F.col("gy") + F.col("h")) * CELL))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A descriptor record per line item."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    names = ("activity", "type", "method", "twig_category", "category", "equipment")
    rows = spark.createDataFrame([(n, *r) for n, r in enumerate(DESCRIPTORS)], "slot long, " + ", ".join(f"{n} string" for n in names))
    slot = (F.col("l_orderkey") * 4 + F.col("l_linenumber")) % len(DESCRIPTORS)
    line = line.join(F.broadcast(rows), slot == F.col("slot"))  # a fixed table of 25 rows
    return line.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("record"), *names, F.col("l_quantity").alias("acres"), F.col("l_shipdate").alias("treatment_date"), F.when(F.col("l_orderkey") % 5 == 0, "Planned").otherwise("Completed").alias("status"), F.when(F.col("l_orderkey") % 7 == 0, "DUPLICATE_DROP").alias("error"), F.when(F.col("l_orderkey") % 4 == 0, "BIL").when(F.col("l_orderkey") % 4 == 1, "CFLR").otherwise("GAOA").alias("fund_source"))


def areas_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of 20 cells per nation, 7 cells off the lattice's corners of blocks."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("aoi_id"))
    x, y = F.col("aoi_id") % 5 * 64 + 7, F.lit(7)
    return n.withColumn("geometry", G.box(x * CELL, y * CELL, (x + 20) * CELL, (y + 20) * CELL))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of 40 cells per hundred customers, in the block of cells where their boxes lie, with
    `code` and `name` of a nation each."""
    d = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 100").alias("district")).distinct()
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"), F.col("n_name").alias("name"))
    d = d.join(n, F.col("district") % 25 == F.col("n_nationkey")).drop("n_nationkey")
    x, y = F.col("district") % 64 * 64 + 7, F.expr("district div 64") * 64 + 7
    return d.withColumn("geometry", G.box(x * CELL, y * CELL, (x + 40) * CELL, (y + 40) * CELL))


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as raw records of a second source: status, error, treatment_date in epoch milliseconds, and a second part ten cells to
    the right for every fourth."""
    k = F.col("OBJECTID")
    own = boxes(spark, sf_dir)
    far = G.box((F.col("gx") + 10) * CELL, F.col("gy") * CELL, (F.col("gx") + 10 + F.col("w")) * CELL, (F.col("gy") + F.col("h")) * CELL)
    date = (F.col("YEAR_COMP") - 1970).cast("long") * 31_557_600_000 + 86_400_000
    parts = F.when(k % 4 == 0, F.concat("geometry", far)).otherwise(F.col("geometry"))
    return own.select(k.alias("record"), "ACTIVITY", F.when(k % 5 == 0, "Planned").otherwise("Completed").alias("status"), F.when(k % 7 == 0, "DUPLICATE_DROP").alias("error"), date.alias("treatment_date"), parts.alias("geometry"))


def bow_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with two corners exchanged, so that their rings cross themselves."""
    own = boxes(spark, sf_dir)
    at = lambda dx, dy: F.struct(((F.col("gx") + dx) * CELL).cast("double").alias("x"), ((F.col("gy") + dy) * CELL).cast("double").alias("y"))
    ring = F.array(at(F.lit(0), F.lit(0)), at(F.col("w"), F.col("h")), at(F.col("w"), F.lit(0)), at(F.lit(0), F.col("h")), at(F.lit(0), F.lit(0)))
    return own.select("OBJECTID", F.array(F.array(ring)).alias("geometry"))


def crosswalk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A descriptor record per part of the driver's table, field and value of the whole crosswalk in turn, each plain, between blanks
    and in capitals."""
    from overlay_jobs.sources.crosswalk import default_crosswalk

    rows = default_crosswalk(spark)
    n = rows.count()
    numbered = rows.orderBy("field", "value").select("field", "value").toPandas()
    values = spark.createDataFrame([(i, f, v) for i, (f, v) in enumerate(numbered.itertuples(index=False))], "slot long, field string, value string")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("record"))
    own = part.join(F.broadcast(values), part["record"] % n == values["slot"])  # the crosswalk is a fixed small table
    form = F.floor(F.col("record") / n) % 3
    text = F.when(form == 1, F.concat(F.lit("  "), "value", F.lit(" "))).when(form == 2, F.upper("value")).otherwise(F.col("value"))
    fields = ("activity", "type", "method", "twig_category")
    return own.select("record", *(F.when(F.col("field") == f, text).alias(f) for f in fields), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("equipment"), F.lit(1.0).alias("acres"))
