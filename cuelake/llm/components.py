"""Connected components of a distributed graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (large: those above it; else those up to it) to the least of its neighbourhood.

    A hub has its rows in one key. The join has a second key, which the least neighbours aren't dealt by, so both
    sides are shuffled for it: only then can Spark split a partition that is too large.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("of"), "m")
    half = lambda c: F.pmod(F.xxhash64(c), F.lit(2))
    joined = both.withColumn("half", half("a")).join(least.withColumn("of_half", half("of")), (F.col("a") == F.col("of")) & (F.col("half") == F.col("of_half")))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b: bigint): root is the least node of its component.

    Each round ends in a table in the shared folder, so no lineage grows. The rounds grow with the logarithm of
    the longest path. Loops and repeated edges are allowed; an empty table gives an empty result. A graph that
    doesn't settle in max_rounds raises an error; nothing is cut short.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        before, now = now, written(_star(_star(now, large=True), large=False), "edges")
        discard(before)
        # settled once all edges are stars: no node has two edges up, none has both an edge up and one from below
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        odd = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down")).where("up > 1 or up > 0 and down > 0")
        if odd.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
