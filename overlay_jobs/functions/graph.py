"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlay_jobs.session import HOT_LEAST, HOT_SHARE, discard, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours are linked to the smallest one around it; small star: its smaller neighbours.

    A node's neighbours are never gathered: the smallest one is a partial aggregate, joined back to the links; nodes with more
    links than a hot key takes theirs by broadcast.
    """
    both = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.where("v < u")
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"), "n")
    side = both.where("v > u") if large else around
    total = 2 * edges.count()
    bound = max(HOT_LEAST, total // HOT_SHARE)
    joined = side.join(least, F.col("u") == F.col("c"))
    if total > bound and least.agg(F.max("n")).head()[0] > bound:
        hot = settle(least.where(F.col("n") > bound), "hot-nodes")
        cold = side.join(F.broadcast(hot), F.col("u") == F.col("c"), "left_anti").join(least, F.col("u") == F.col("c"))
        joined = side.join(F.broadcast(hot), F.col("u") == F.col("c")).select("u", "v", "c", "m").union(cold.select("u", "v", "c", "m"))
    own = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        own = own.union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return own.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """node, component (its smallest node) for every node of a link; links to itself and null ends are left out.

    Ends when every node but the smallest of each component has one link, to that smallest one: after a number of rounds that grows
    with the logarithm of the longest chain. Every round's links are settled.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links-0")
    for n in range(rounds):
        ends = edges.select("u", F.lit(1).alias("up")).union(edges.select(F.col("v").alias("u"), F.lit(-1).alias("up")))
        if not ends.groupBy("u").agg(F.max("up").alias("hi"), F.min("up").alias("lo"), F.count_if(F.col("up") > 0).alias("k")).where("k > 1 OR hi <> lo").limit(1).count():
            break
        large = settle(_star(edges, True), f"links-{n + 1}-large")
        last, edges = edges, settle(_star(large, False), f"links-{n + 1}")
        discard(last, large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
