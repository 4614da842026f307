"""The last writer's value over a timeline, as intervals: a sweep over starts and ends, in ranges of the timeline."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import saved


class _Sweep:
    """Over spans in order of (media, part, start): maximal runs of the writer with the greatest ord.

    A heap has the spans that are open; those that have ended leave when they come to its top.
    """

    def __init__(self):
        self.key = None

    def open(self, key: tuple, limit: int | None) -> None:
        self.key, self.limit, self.heap, self.at, self.run = key, limit, [], None, None

    def until(self, stop: int | None) -> Iterator[tuple]:
        """Runs up to before stop (None: to the end)."""
        while self.heap and (stop is None or self.at < stop):
            order, last, value = self.heap[0]
            if last < self.at:
                heappop(self.heap)
                continue
            end = last if stop is None else min(last, stop - 1)
            if self.run and self.run[2] == order and self.run[1] + 1 == self.at:
                self.run[1] = end
            else:
                if self.run:
                    yield self.row()
                self.run = [self.at, end, order, value]
            self.at = end + 1

    def row(self) -> tuple:
        first, last, order, value = self.run
        return (*self.key, first, last, -order[0], -order[1], value)

    def close(self) -> Iterator[tuple]:
        if self.key is not None:
            yield from self.until(self.limit)
            if self.run:
                yield self.row()

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for pdf in batches:
            out: list[tuple] = []
            limits = pdf["_next"].astype("Int64")
            for media, part, start, first, last, ord_, value, limit in zip(pdf["media_id"], pdf["part"], pdf["_start"], pdf["first"], pdf["last"], pdf["ord"], pdf["value"], limits):
                if (media, part) != self.key:
                    out += self.close()
                    self.open((media, part), None if limit is pd.NA else int(limit))
                out += self.until(start)
                self.at = start
                heappush(self.heap, ((-ord_, -first), last, value))
            yield out
        yield list(self.close())
        self.key = None


def overlay_runs(spans: DataFrame) -> DataFrame:
    """media_id, first, last, value: maximal runs of samples with one last writer.

    spans: media_id, ord, first, last (inclusive), value. At every sample the span of the greatest ord counts, of equal ones that
    which starts last. Spans without samples have no run; a null media_id is a medium. What moves is proportional to spans,
    however long they are: ranges of (medium, start) are swept apart, and a range gets the spans that are open at its
    beginning from those before it. A run that a border cuts is joined again; at most two runs of a range touch one.
    """
    spark = spans.sparkSession
    rows = spans.where("last >= first").groupBy("media_id", "first", "last").agg(F.max("ord").alias("ord"), F.max_by("value", "ord").alias("value"))
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "media_id", "first").sortWithinPartitions("media_id", "first")
    placed = saved(dealt.withColumn("part", F.spark_partition_id().cast("bigint")), "spans")
    lows = placed.groupBy("media_id", "part").agg(F.min("first").alias("low"))
    ranges = saved(lows.withColumn("_next", F.lead("low").over(Window.partitionBy("media_id").orderBy("part"))), "ranges")
    of = ranges.select(F.col("media_id").alias("_m"), F.col("part").alias("_p"), "low", "_next")
    own = placed.join(of, F.col("media_id").eqNullSafe(F.col("_m")) & (F.col("part") == F.col("_p"))).drop("_m", "_p")
    # spans that reach into further ranges of their medium are open there
    after = ranges.where("_next is not null or part > 0").groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("low", "part", "_next"))).alias("there")).withColumnRenamed("media_id", "_m")
    crossing = own.where("last >= _next").drop("low", "_next", "part").join(after, F.col("media_id").eqNullSafe(F.col("_m")))
    carried = crossing.select("media_id", "first", "last", "ord", "value", F.explode(F.filter("there", lambda x: (x["low"] > F.col("first")) & (x["low"] <= F.col("last")))).alias("x"))
    carried = carried.select("media_id", F.col("x.part").alias("part"), F.col("x.low").alias("_start"), "first", "last", "ord", "value", F.col("x._next").alias("_next"))
    every = own.select("media_id", "part", F.col("first").alias("_start"), "first", "last", "ord", "value", "_next").unionByName(carried)
    kinds = {f.name: f.dataType for f in placed.schema.fields}
    schema = StructType([StructField("media_id", kinds["media_id"]), StructField("part", LongType()), *[StructField(n, LongType()) for n in ("first", "last", "ord", "origin")], StructField("value", kinds["value"])])

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _Sweep()(batches):
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = saved(every.repartition(n, "media_id", "part").sortWithinPartitions("media_id", "part", "_start").mapInPandas(sweep, schema), "runs")
    bordered = runs.join(of, F.col("media_id").eqNullSafe(F.col("_m")) & (F.col("part") == F.col("_p"))).drop("_m", "_p")
    touches = F.coalesce((F.col("first") == F.col("low")) | (F.col("last") == F.col("_next") - 1), F.lit(False))
    columns = ["media_id", "first", "last", "value"]
    by = Window.partitionBy("media_id").orderBy("first")
    goes_on = (F.lag("last").over(by) + 1 == F.col("first")) & (F.lag("ord").over(by) == F.col("ord")) & (F.lag("origin").over(by) == F.col("origin"))
    edges = bordered.where(touches).withColumn("_opens", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    edges = edges.withColumn("_k", F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.groupBy("media_id", "_k").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("value").alias("value"))
    return bordered.where(~touches).select(*columns).unionByName(edges.select(*columns))
