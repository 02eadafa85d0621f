"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

A row's 60-bit hash of its id and text places it on a line; a source's budget is a threshold on it. Sizes are summed by source and leading
digit of the hash; the digit where the running sum passes the budget is the only one that is refined by the next digit. In the
end a filter on the hash takes the rows: nothing is sorted, and no key gathers rows. Budgets above a source's size take whole
rounds of it first (nested thresholds: round k + 1 takes part of what round k takes). Rows that are equal in id and text share a
place; where the boundary falls on such rows, as many of them are taken as the budget has room for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.llm.quality import n_words
from overlay_jobs.session import broadcast_if_small, settle

#: The hash has DIGITS digits of BITS bits.
BITS, DIGITS = 12, 5
WEIGHTS = (5, 2, 1)


def place(id_: Column, text: Column) -> Column:
    """60 bits of an MD5 of id and text, the same in any SQL engine. Nulls: as the empty text."""
    both = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size -> with target. Weights repeat over sources by code point, null last; together targets are the total of
    sizes; none is above `most` times its source's size, the excess is shared again by weight (the level where a filling vessel
    stands). Reads one row per source."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double")
    sized = sources.select("source", "source_size", weight.alias("w"), (most * F.col("source_size")).cast("double").alias("cap"))
    by_room = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    levels = sized.select("*", level.alias("level"), F.row_number().over(by_room).alias("k"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("k", "level"))
    water = F.min(fits).over(everything)["level"]
    return levels.select("source", "source_size", F.least(F.col("w") * F.coalesce(water, F.lit(0.0)), F.col("cap")).alias("target"))


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of the rows, and per source (key): source_size, target, rounds, the edge of the next round (hashes below it
    are in), how many rows on the edge are in (some) and how many there are (of)."""
    slim = settle(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), place(F.col(id_col), F.col(text_col)).alias("h")), "mix-sizes")
    goals = settle(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.select("*", rounds.alias("rounds")).select("*", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"))
    bound = goals.select("source", F.lit(0).cast("long").alias("prefix"), "budget", F.lit(0.0).alias("under"))
    for digit in range(DIGITS):
        shift = BITS * (DIGITS - 1 - digit)
        small = broadcast_if_small(bound.select(F.col("source").alias("own"), "prefix", "budget", "under"))
        inside = slim.join(small, F.col("source").eqNullSafe(F.col("own")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        cells = inside.groupBy("source", F.shiftright("h", shift).alias("cell")).agg(F.count("*").alias("of"), F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("budget").alias("budget"), F.first("under").alias("under"))
        run = F.col("under") + F.sum("size").over(Window.partitionBy("source").orderBy("cell"))
        passed = cells.select("*", run.alias("run")).where("run > budget")
        edge = F.min(F.struct("cell", "lo", "hi", "of", "size", "run", "budget")).alias("e")
        bound = settle(passed.groupBy("source").agg(edge).select("source", F.col("e.cell").alias("prefix"), F.col("e.budget").alias("budget"), (F.col("e.run") - F.col("e.size")).alias("under"), F.col("e.size").alias("size"), F.col("e.of").alias("of"), F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi")), f"mix-bounds-{digit}")
        if not bound.where("lo < hi").limit(1).count():
            break
    # of the rows on the boundary those are taken that bring the sum nearest to the budget
    room = F.ceil((F.col("budget") - F.col("under")) / (F.col("size") / F.col("of")) - 0.5)
    last = bound.select(F.col("source").alias("own"), F.col("lo").alias("edge"), F.greatest(F.lit(0), F.least("of", room)).alias("some"), "of")
    zero = F.lit(0).cast("long")
    out = goals.join(last, F.col("source").eqNullSafe(F.col("own")), "left").select(F.col("source").alias("key"), "source_size", "target", "rounds", *(F.coalesce(c, zero).alias(c) for c in ("edge", "some", "of")))
    return slim, settle(out, "mix-plan")


def _with_copies(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """rows (source, h, ...) with their source's plan and `copies`. Rows on an edge of which only some are in are numbered, all
    tasks each for its own rows, with the counts per task as offsets."""
    joined = rows.join(broadcast_if_small(plans), F.col("source").eqNullSafe(F.col("key")))
    on_edge, split = F.col("h") == F.col("edge"), (F.col("some") > 0) & (F.col("some") < F.col("of"))
    inside = (F.col("h") < F.col("edge")) | (on_edge & (F.col("some") > 0))
    plain = joined.withColumn("copies", F.col("rounds") + inside.cast("long"))
    if not plans.where(split).limit(1).count():
        return plain
    edge = joined.where(on_edge & split).sortWithinPartitions("source").withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    edge = settle(edge, "mix-edge")
    begins = edge.groupBy("source", "task").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.select(F.col("source").alias("s"), F.col("task").alias("t"), "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    edge = edge.join(F.broadcast(begins), F.col("source").eqNullSafe(F.col("s")) & (F.col("task") == F.col("t")))  # a row per task and source
    edge = edge.withColumn("copies", F.col("rounds") + (F.col("at") - F.col("least") + F.col("before") < F.col("some")).cast("long"))
    return plain.where(~(on_edge & split)).unionByName(edge.select(*plain.columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """One row per input row: id, source, size (words), source_size, target, copies, taken (words taken, repeats counted).

    Null texts have size 0; a null source is a source of its own, the last; rows with equal ids but other texts have places of
    their own; rows that are equal in both are taken or left one by one; very long texts are counted whole; an empty table gives
    an empty result; other columns are not read. A source's taken words differ from its target by half of its boundary row at
    most.
    """
    slim, plans = plan(docs, id_col, text_col, source_col, weights, most)
    out = _with_copies(slim, plans)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """The mix itself: every row with all its columns, as often as it is taken; cases as for mix(). Rows are not shuffled. Which of
    rows that are equal in id and text are taken is open if they differ in other columns."""
    _, plans = plan(docs, id_col, text_col, source_col, weights, most)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), place(F.col(id_col), F.col(text_col)).alias("h"))
    out = _with_copies(rows, plans).where("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
