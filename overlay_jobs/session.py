"""Helpers that every job shares: the shared folder, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 100_000
#: Bytes of input to a core below which rows may be dealt out anew.
SMALL_BYTES = 32 << 20
#: A key is hot if it has more than a HOT_SHARE-th of all rows, and HOT_LEAST rows at least: there are at most HOT_SHARE such keys.
HOT_SHARE, HOT_LEAST = 1_000, 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set a new temporary one if the master is local, else ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def discard(*settled: DataFrame) -> None:
    """Remove settled tables that nothing will read any more: everything made from them must be settled itself by now."""
    for df in settled:
        if path := getattr(df, "_settled_path", None):
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def dealt_out(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores where its files are fewer than that and too small to be split so, as for work that
    is long for its bytes; else as it is."""
    sc = df.sparkSession.sparkContext
    files = df.inputFiles()
    if not 0 < len(files) < sc.defaultParallelism:
        return df
    hadoop = sc._jvm.org.apache.hadoop.fs
    paths = [hadoop.Path(f) for f in files]
    size = sum(p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return df.repartition(sc.defaultParallelism) if size < SMALL_BYTES * sc.defaultParallelism else df


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a settled, narrow table for broadcast if it has at most `rows` rows; else leave the choice to Spark's planner."""
    return F.broadcast(df) if df.count() <= rows else df


def join_hot(left: DataFrame, right: DataFrame, key: str, own: str) -> DataFrame:
    """left left-joined with right on left.key = right.own, where `own` is unique and some keys may hold most rows of left.

    Keys that are hot in left take their row of right by broadcast (HOT_SHARE rows at most), the others by an ordinary join, so no
    task gets all rows of a key. Both sides should be settled, as they are read more than once.
    """
    total = left.count()
    bound = max(HOT_LEAST, total // HOT_SHARE)
    counts = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))
    if total <= bound or (counts.agg(F.max("_n")).head()[0] or 0) <= bound:
        return left.join(right, F.col(key) == F.col(own), "left")
    hot = settle(counts.where(F.col("_n") > bound).select("_hot"), "hot-keys")
    some = right.join(F.broadcast(hot), F.col(own) == F.col("_hot"), "left_semi")
    is_hot = F.col(key) == F.col("_hot")
    return left.join(F.broadcast(hot), is_hot, "left_anti").join(right, F.col(key) == F.col(own), "left").unionByName(
        left.join(F.broadcast(hot), is_hot, "left_semi").join(F.broadcast(some), F.col(key) == F.col(own), "left"))
