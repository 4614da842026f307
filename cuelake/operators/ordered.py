"""Running values over one long order, without one task per key.

A window over a key alone puts a hot key's rows in one task. Here rows are windowed within (key, block), where a
block is a stretch of the order; what crosses blocks (counts, neighbours) is taken from one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

#: Bits of a row's number within its range, and of those the low ones that number it within its block.
RANGE_BITS, BLOCK_BITS = 33, 16


def ranged(df: DataFrame, keys: list[str], order: list[str], ties: list[str], name: str) -> DataFrame:
    """df as a table in the order of keys, order and ties, with _at, which rises along it, and _block, in which no more than 65,536 rows are.

    Ranges are cut by sampled rows rather than by values, so their size doesn't depend on how dense the order is. Rows alike
    in keys and order are in one range. The table is written once, so numbers hold whatever is read from it again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order, *ties)
    return saved(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_block", F.shiftright("_at", BLOCK_BITS))


def _blocks(df: DataFrame, keys: list[str], order: list[str], block: Column) -> tuple[DataFrame, Window]:
    df = df.withColumn("_block", block)
    return df, Window.partitionBy(*keys, "_block").orderBy(*order)


def _joined(df: DataFrame, per_block: DataFrame, keys: list[str]) -> DataFrame:
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_block").eqNullSafe(F.col("_b"))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    renamed = per_block.withColumnRenamed("_block", "_b")
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_k{i}")
    return df.join(renamed, cond, "left").drop("_b", *[f"_k{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, out: str) -> DataFrame:
    """Inclusive running sum of value by order, per key. block must not fall as the order rises."""
    df, w = _blocks(df.withColumn("_v", value), keys, order, block)
    df = df.withColumn("_local", F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = df.groupBy(*keys, "_block").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    return _joined(df, sums, keys).withColumn(out, F.col("_local") + F.col("_offset")).drop("_v", "_local", "_offset", "_block")


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column, out: str) -> DataFrame:
    """1-based row numbers by order, per key."""
    return running_sum(df, keys, order, block, F.lit(1).cast("bigint"), out)


def with_next(df: DataFrame, keys: list[str], order: list[str], block: Column, column: str, out: str) -> DataFrame:
    """The column's value in the next row by order, per key; null in the last."""
    df, w = _blocks(df, keys, order, block)
    df = df.withColumn("_ahead", F.lead(column).over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    firsts = df.groupBy(*keys, "_block").agg(F.min_by(column, F.struct(*order)).alias("_first"))
    after = Window.partitionBy(*keys).orderBy("_block")
    firsts = firsts.select(*keys, "_block", F.lead("_first").over(after).alias("_then"))
    return _joined(df, firsts, keys).withColumn(out, F.when(F.col("_last"), F.col("_then")).otherwise(F.col("_ahead"))).drop("_ahead", "_last", "_then", "_block")


def with_previous(df: DataFrame, keys: list[str], order: list[str], block: Column, column: str, out: str) -> DataFrame:
    """The column's value in the row before by order, per key; null in the first."""
    df, w = _blocks(df, keys, order, block)
    df = df.withColumn("_behind", F.lag(column).over(w)).withColumn("_first", F.lag(F.lit(1)).over(w).isNull())
    lasts = df.groupBy(*keys, "_block").agg(F.max_by(column, F.struct(*order)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block")
    lasts = lasts.select(*keys, "_block", F.lag("_last").over(before).alias("_then"))
    return _joined(df, lasts, keys).withColumn(out, F.when(F.col("_first"), F.col("_then")).otherwise(F.col("_behind"))).drop("_behind", "_first", "_then", "_block")
