"""Exact quantiles in bounded memory: histograms whose cells that hold the asked ranks are refined, pass by pass."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.session import broadcast_if_small, discard, settle

#: Rows of a group up to which one aggregate holds its values; cells of a histogram.
SMALL, CELLS = 1_000_000, 4_096


def exact_quantile(df: DataFrame, value: Column, q: float, by: Column | None = None, small: int = SMALL) -> DataFrame:
    """group, quantile: one quantile of one column, see exact_quantiles."""
    return exact_quantiles(df, {"value": value}, (q,), by, small).select("group", F.get("quantiles", F.lit(0)).alias("quantile"))


def exact_quantiles(df: DataFrame, values: Mapping[str, Column], qs: Sequence[float], by: Column | None = None, small: int = SMALL) -> DataFrame:
    """column, group, quantiles: the asked quantiles, in their order, of each of `values` in each group.

    Doubles, linear between neighbours as percentile() has it, over what is neither null nor NaN; a column without such values in a
    group has no row. The null group is a group. Infinite values count as the least and greatest.

    Groups of at most `small` rows go through percentile(). For larger ones all ranks of all columns and groups are refined
    together: a pass counts values in CELLS equal cells between the bounds of each rank, which ranks in one cell share, and the cell
    that holds a rank gives its next bounds, until every rank is known to the value. A pass holds CELLS counts for each of these
    stretches, whatever a group's size; how many passes there are does not depend on how many quantiles are asked.
    """
    if not values or not qs or not all(0 <= q <= 1 for q in qs):
        raise ValueError("columns and quantiles from 0 to 1 are needed")
    group = by if by is not None else F.lit(None).cast("string")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("column"), c.cast("double").alias("v")) for name, c in values.items())))
    own = df.select(group.alias("group"), each.alias("x")).select("x.column", "group", "x.v").where("v IS NOT NULL AND NOT isnan(v)")
    sizes = own.groupBy("column", "group").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    if (sizes.agg(F.max("n")).head()[0] or 0) <= small:
        return own.groupBy("column", "group").agg(F.percentile("v", F.array(*(F.lit(float(q)) for q in qs))).alias("quantiles"))
    own = settle(own, "quantile-values")
    sizes = settle(own.groupBy("column", "group").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-sizes")
    at = [F.lit(float(q)) * (F.col("n") - 1) for q in qs]
    ranks = F.array_distinct(F.concat(*(F.array(F.floor(a), F.ceil(a)) for a in at)))
    state = settle(sizes.select(F.col("column").alias("c"), F.col("group").alias("g"), "lo", "hi", F.lit(0).cast("long").alias("below"), ranks.alias("ranks")), "quantile-state")
    stretch = ("c", "g", "lo", "hi", "below")  # ranks aside
    known = None
    while state.limit(1).count():
        inside = own.join(broadcast_if_small(state), (F.col("column") == F.col("c")) & F.col("group").eqNullSafe(F.col("g")) & F.col("v").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy(*stretch, _cell().alias("cell")).agg(F.count("*").alias("k"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("ranks").alias("ranks"))
        counts = counts.withColumn("end", F.col("below") + F.sum("k").over(Window.partitionBy(*stretch).orderBy("cell"))).withColumn("begin", F.col("end") - F.col("k"))
        held = F.filter("ranks", lambda r: (r >= F.col("begin")) & (r < F.col("end")))
        found = counts.withColumn("ranks", held).where(F.size("ranks") > 0).select("c", "g", "begin", "end", "least", "most", "ranks")
        found = settle(found, "quantile-cells")
        first, last = (lambda r: r == F.col("begin")), (lambda r: r == F.col("end") - 1)
        told = lambda r: (F.col("least") == F.col("most")) | first(r) | last(r)
        ready = found.select("c", "g", F.explode(F.filter("ranks", told)).alias("rank"), "begin", "least", "most")
        ready = ready.select("c", "g", "rank", F.when(F.col("rank") == F.col("begin"), F.col("least")).otherwise(F.col("most")).alias("v"))
        known = ready if known is None else known.unionByName(ready)
        rest = found.withColumn("ranks", F.filter("ranks", lambda r: ~told(r))).where(F.size("ranks") > 0)
        discard(state)
        state = settle(rest.select("c", "g", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("begin").alias("below"), "ranks"), "quantile-state")
    discard(own, state)
    told = known.groupBy("c", "g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("known"))
    rows = sizes.join(told, (F.col("column") == F.col("c")) & F.col("group").eqNullSafe(F.col("g")))
    low, high = (lambda a: F.col("known")[F.floor(a)]), (lambda a: F.col("known")[F.ceil(a)])
    value = lambda a: F.when(low(a) == high(a), low(a)).otherwise((F.ceil(a) - a) * low(a) + (a - F.floor(a)) * high(a))
    return rows.select("column", "group", F.array(*(value(a) for a in at)).alias("quantiles"))


def _cell() -> Column:
    """The cell of v between lo and hi: 0 to CELLS - 1 for finite values, -1 and CELLS for infinite ones. Least and greatest value of a
    stretch are never in one cell unless they are equal."""
    top = F.lit(float("inf"))
    lo, hi = F.greatest("lo", F.lit(-sys.float_info.max)) / 2, F.least("hi", F.lit(sys.float_info.max)) / 2  # halves: no overflow
    share = F.try_divide(F.col("v") / 2 - lo, hi - lo)  # null where the halves are equal
    inner = F.when(share.isNull(), F.when(F.col("v") == F.col("hi"), CELLS - 1).otherwise(0)).otherwise(F.greatest(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)), F.lit(0)))
    return F.when(F.col("v") == -top, -1).when(F.col("v") == top, CELLS).otherwise(F.when(F.col("lo") < F.col("hi"), inner).otherwise(0))
