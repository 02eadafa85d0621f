"""Chat formatting by perspective rotation, with DataFrame functions only.

Every participant of a dialogue gets a rendering of its own: that speaker's turns are the assistant's, all others' are named
users', and the masks mark the assistant's words. A dialogue is rendered in parts of PART turns by their place in it, so that an
endless one is many rows, whatever its turns' numbers; offsets go through the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.session import HOT_LEAST, HOT_SHARE, broadcast_if_small, settle

#: Turns in a part; roles that are no participants.
PART, NARRATORS = 256, ("system",)


def _head(role: Column, speaker: Column) -> Column:
    named = F.concat(F.lit("<|im_start|>user name="), F.coalesce(role, F.lit("unknown")), F.lit("\n"))
    return F.when(role == speaker, F.lit("<|im_start|>assistant\n")).when(role.isin(*NARRATORS), F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))).otherwise(named)


def _placed(own: DataFrame) -> DataFrame:
    """Adds `place`, 0, 1 ... in each conversation c by n, r and t, without a conversation in one task.

    Rows are sorted by ranges; a row's number ties equal rows apart, so that these spread too. A conversation's rows are numbered
    within each range, and its counts per range (a row each) give the offsets.
    """
    order = ["c", "n", "r", "t", "row"]
    own = settle(own.withColumn("row", F.monotonically_increasing_id()), "chat-turns")
    own = settle(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "chat-ranges")
    begins = own.groupBy("range", "c").agg(F.count("*").alias("k"), F.min("at").alias("least"))
    before = Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.select(F.col("range").alias("of"), F.col("c").alias("oc"), "least", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    out = own.join(begins, (F.col("range") == F.col("of")) & F.col("c").eqNullSafe(F.col("oc")))
    return out.select("c", "n", "r", "t", (F.col("at") - F.col("least") + F.col("before")).alias("place"))


def _with_speakers(parts: DataFrame, speakers: DataFrame) -> DataFrame:
    """Settled parts with each speaker of their conversation. Conversations of very many parts have their speakers broadcast where
    these are few, so that their parts stay where they are; no task gets all of them."""
    same = F.col("c").eqNullSafe(F.col("sc"))
    total = parts.count()
    counts = parts.groupBy(F.col("c").alias("hc")).agg(F.count("*").alias("k")).where(F.col("k") > max(HOT_LEAST, total // HOT_SHARE))
    hot = settle(counts.select("hc"), "chat-hot")  # HOT_SHARE rows at most
    if total <= HOT_LEAST or not hot.head(1):
        return parts.join(speakers, same)
    is_hot, theirs = F.col("c").eqNullSafe(F.col("hc")), F.col("sc").eqNullSafe(F.col("hc"))
    some = broadcast_if_small(settle(speakers.join(F.broadcast(hot), theirs, "left_semi"), "chat-hot-speakers"))
    others = parts.join(F.broadcast(hot), is_hot, "left_anti").join(speakers, same)
    return others.unionByName(parts.join(F.broadcast(hot), is_hot, "left_semi").join(some, same))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """conv, speaker, part, n_turns, rendered, masks ("start:end" in code points of the whole rendering, comma-joined), n_masked.

    Turns stand by number, then role, then text (nulls first). A null text is empty; "<|" inside a text is written "< |"; a null
    role is a named user "unknown" and no participant, as are narrators; a conversation of narrators only has no rendering;
    repeated rows are rendered as often as they stand; a null conversation id is a conversation; an empty table gives an empty
    result; other columns are not read.
    """
    own = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("n"), F.col(role_col).alias("r"), F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("t"))
    parts = _placed(own).groupBy("c", F.floor(F.col("place") / part).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("n", "r", "t"))).alias("turns"))
    parts = settle(parts, "chat-parts")
    speakers = own.where(F.col("r").isNotNull() & ~F.col("r").isin(*NARRATORS)).select(F.col("c").alias("sc"), F.col("r").alias("speaker")).distinct()
    views = _with_speakers(parts, settle(speakers, "chat-speakers"))
    tail = "<|im_end|>\n"
    pieces = F.transform("turns", lambda x: F.struct(_head(x["r"], F.col("speaker")).alias("head"), x["t"].alias("body"), F.coalesce(x["r"] == F.col("speaker"), F.lit(False)).alias("own")))
    views = views.select("c", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    views = views.select("c", "speaker", "part", "n_turns", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("rendered"), "pieces")
    # offsets come from slim rows: the texts never go through the window
    before = Window.partitionBy("c", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = views.select("c", "speaker", "part", F.length("rendered").cast("long").alias("size"))
    sizes = sizes.select(F.col("c").alias("wc"), F.col("speaker").alias("ws"), F.col("part").alias("wp"), F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))
    views = views.join(sizes, F.col("c").eqNullSafe(F.col("wc")) & (F.col("speaker") == F.col("ws")) & (F.col("part") == F.col("wp")))
    start = F.struct(F.col("offset").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        body = state["at"] + F.length(p["head"])
        end = body + F.length(p["body"])
        span = F.array(F.struct(body.cast("long").alias("a"), end.cast("long").alias("b")))
        return F.struct((end + len(tail)).cast("long").alias("at"), F.when(p["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("pieces", start, step)["spans"]
    views = views.select("c", "speaker", "part", "n_turns", "rendered", spans.alias("spans"))
    masks = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["a"], s["b"])), ",")
    masked = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])
    return views.select(F.col("c").alias(conv_col), "speaker", "part", "n_turns", "rendered", masks.alias("masks"), masked.alias("n_masked"))
