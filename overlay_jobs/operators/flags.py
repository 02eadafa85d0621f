"""Records whose mapped and reported acres disagree, and the figures that describe them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.operators.quantiles import exact_quantile
from overlay_jobs.session import broadcast_if_small, settle

#: Smallest difference in acres that the residual flag takes.
FLOOR_ACRES = 900 * 0.000247105


def _valid(mgt_col: str) -> Column:
    return (F.col("gis_acres") > 0) & (F.col(mgt_col) > 0)


def log_fit(df: DataFrame, mgt_col: str = "ACRES_MGT") -> DataFrame:
    """One row: n, slope, intercept, r2 and resid_std of log10(reported) on log10(gis_acres). Fewer than two valid rows: nulls."""
    x, y = F.log10("gis_acres"), F.log10(F.col(mgt_col))
    own = df.where(_valid(mgt_col)).select(x.alias("x"), y.alias("y"))
    fit = own.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    squares = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return fit.select("n", "slope", "intercept", "r2", F.when(F.col("n") > 1, F.sqrt(squares / (F.col("n") - 1))).alias("resid_std"))


def flag_acre_mismatch(df: DataFrame, n_std: float = 3.0, min_area_acres: float = FLOOR_ACRES, gis_col: str = "ACRES_GIS", mgt_col: str = "ACRES_MGT", group_col: str = "ACTIVITY", approximate: bool = False) -> DataFrame:
    """Adds acres_diff, log_ac_pred, log_ac_resid, ac_flag and ac_flag_abs; filters nothing. Needs gis_acres.

    ac_flag: residual under -n_std deviations and a difference above the floor. ac_flag_abs: difference above the 99th percentile
    of its group; a null group has none. Two aggregates (one row; one row a group), joined back as broadcasts if small.
    """
    if mgt_col not in df.columns:
        out = df.withColumns({"acres_diff": F.col("gis_acres"), "log_ac_pred": F.lit(None).cast("double"), "log_ac_resid": F.lit(None).cast("double"), "ac_flag": F.lit(False)})
    else:
        n, slope, intercept, _, std = log_fit(df, mgt_col).head()
        line = F.lit(intercept).cast("double") + F.lit(slope).cast("double") * F.log10("gis_acres")
        out = df.withColumn("acres_diff", F.col(gis_col) - F.col(mgt_col)).withColumn("log_ac_pred", F.when(_valid(mgt_col), line))
        out = out.withColumn("log_ac_resid", F.when(_valid(mgt_col), F.log10(F.col(mgt_col)) - F.col("log_ac_pred")))
        out = out.withColumn("ac_flag", F.coalesce((F.col("log_ac_resid") < F.lit(None if std is None else -n_std * std).cast("double")) & (F.col("acres_diff") > min_area_acres), F.lit(False)))
    grouped = out.where(F.col(group_col).isNotNull())
    if approximate:
        limits = grouped.groupBy(F.col(group_col).alias("_group")).agg(F.percentile_approx("acres_diff", 0.99, 10_000).cast("double").alias("_p99"))
    else:
        limits = exact_quantile(grouped, F.col("acres_diff"), 0.99, F.col(group_col)).select(F.col("group").alias("_group"), F.col("quantile").alias("_p99"))
    limits = settle(limits, "flag-limits")
    out = out.join(broadcast_if_small(limits), F.col(group_col) == F.col("_group"), "left")
    return out.withColumn("ac_flag_abs", F.coalesce(F.col("acres_diff") > F.col("_p99"), F.lit(False))).drop("_group", "_p99")


def unflagged(df: DataFrame) -> DataFrame:
    return df.where(~(F.col("ac_flag") | F.col("ac_flag_abs")))


def flag_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("ac_flag").alias("residual"), F.count_if("ac_flag_abs").alias("absolute"), F.count_if(F.col("ac_flag") | F.col("ac_flag_abs")).alias("either"))


def flags_by_group(df: DataFrame, group_col: str = "ACTIVITY") -> DataFrame:
    """Flagged records by group: n and median acres_diff."""
    own = settle(df.where(F.col("ac_flag") & F.col(group_col).isNotNull()).select(group_col, "acres_diff"), "flagged-groups")
    middle = exact_quantile(own, F.col("acres_diff"), 0.5, F.col(group_col)).select(F.col("group").alias("_group"), F.col("quantile").alias("median_diff"))
    return own.groupBy(group_col).agg(F.count("*").alias("n")).join(middle, F.col(group_col) == F.col("_group"), "left").drop("_group")


EDGES = (0, 1, 10, 100, 1_000, 10_000)
NAMES = ("0-1", "1-10", "10-100", "100-1k", "1k-10k", ">10k")


def size_class(acres: Column) -> Column:
    """Right-closed classes; nothing at or below zero."""
    out = F.when(acres <= 0, F.lit(None).cast("string"))
    for name, top in zip(NAMES, EDGES[1:]):
        out = out.when(acres <= top, F.lit(name))
    return out.when(acres.isNotNull(), F.lit(NAMES[-1]))


def flag_rate_by_size(df: DataFrame, acres_col: str = "ACRES_GIS") -> DataFrame:
    """Records and flag rate (%) by size class, and over all."""
    own = df.select(size_class(F.col(acres_col)).alias("size_class"), F.col("ac_flag").cast("int").alias("f"))
    rates = (F.count("*").alias("n"), (100 * F.avg("f")).alias("rate"))
    return own.where("size_class IS NOT NULL").groupBy("size_class").agg(*rates).unionByName(own.agg(*rates).withColumn("size_class", F.lit("all")))


def residual_histogram(df: DataFrame, edges: int = 50) -> DataFrame:
    """bin, kept, flagged: residuals in edges - 1 equal bins from the least to the greatest, the last one closed."""
    own = df.where("log_ac_resid IS NOT NULL")
    lo, hi = own.agg(F.min("log_ac_resid"), F.max("log_ac_resid")).head()
    width = ((hi - lo) / (edges - 1)) if lo is not None and hi > lo else 1.0
    at = F.least(F.floor((F.col("log_ac_resid") - F.lit(lo).cast("double")) / width), F.lit(edges - 2)).cast("int")
    return own.groupBy(at.alias("bin")).agg(F.count_if(~F.col("ac_flag")).alias("kept"), F.count_if("ac_flag").alias("flagged"))


def share_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows, and shares of null and of zero by column."""
    return df.agg(F.count("*").alias("n"), *(F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null") for c in cols), *(F.avg(F.coalesce(F.col(c) == 0, F.lit(False)).cast("int")).alias(f"{c}_zero") for c in cols))
