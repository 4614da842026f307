"""Calls of a service that are paid once: answers are kept by a digest of the request."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.store import store_of
from .providers import Provider


class TokenBucket:
    """Lets through per_second requests a second in the long run, and up to burst at once."""

    def __init__(self, per_second: float, burst: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if per_second <= 0 or burst < 1:
            raise ValueError("a bucket needs a rate above 0 and room for a request")
        self.per_second, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self, n: int) -> None:
        """Waits until n requests may go; more than burst go as what they are worth in time."""
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.per_second) - n
        self.at = now
        if self.tokens < 0:
            self.sleep(-self.tokens / self.per_second)


def _schema(result: str) -> StructType:
    return StructType([StructField("_digest", StringType()), *StructType.fromDDL(result).fields])


def _answered(df: DataFrame, store: str, result: str) -> DataFrame:
    """_digest and answer of every request in the store, each once."""
    files, root = store_of(store)
    files.create_dir(root, recursive=True)
    return df.sparkSession.read.schema(_schema(result)).parquet(store).dropDuplicates(["_digest"])


def call_once(df: DataFrame, provider: Provider, name: str, inputs: Sequence[str], result: str, store: str, calls_at_once: int = 8, per_second: float | None = None, retries: int = 2, batch: int = 32) -> DataFrame:
    """df with the provider's answers in columns (result: their schema); requests in the store aren't sent.

    A request is what the inputs hold, nulls included, for the service called name. Equal ones are one call. A task sends
    batches in order of their digests and writes each batch's answers to the store, a folder that all executors reach,
    before it sends the next one; a repeated task finds the batches of its first attempt there, and a run that comes after a
    lost one joins them before calling. What can be paid twice is a batch that was under way, or two attempts at once
    (speculation). Requests that fail to the end get nulls and are sent again by the next run. At most calls_at_once
    tasks call, each per_second requests a second, in bursts of a batch. A service that isn't healthy raises before a call.
    """
    schema = _schema(result)
    request = F.to_json(F.struct(F.lit(name).alias("service"), *[F.col(c) for c in inputs]), {"ignoreNullFields": "false"})
    rows = df.withColumn("_digest", F.sha2(request, 256))
    known = _answered(df, store, result).select("_digest")
    missing = rows.select("_digest", *inputs).dropDuplicates(["_digest"]).join(known, "_digest", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        files, root = store_of(store)
        shape, bucket, checked = to_arrow_schema(schema), None, False
        for part in _cut(batches, batch):
            digests = part["_digest"].tolist()
            where = f"{root}/{hashlib.sha256(''.join(digests).encode()).hexdigest()}.parquet"
            if files.get_file_info(where).is_file:
                continue
            if not checked and not provider.healthy():
                raise RuntimeError("the service is not healthy")
            checked, requests = True, part[list(inputs)].to_dict("records")
            answers: dict[str, dict[str, Any]] = {}
            for _ in range(retries + 1):
                todo = [k for k, d in enumerate(digests) if d not in answers]
                if not todo:
                    break
                if per_second:
                    bucket = bucket or TokenBucket(per_second, batch)
                    bucket.take(len(todo))
                got = provider.call([requests[k] for k in todo])
                answers |= {digests[k]: a for k, a in zip(todo, got) if a is not None}
            if answers:
                # under a name that no reader takes until it is whole
                draft = f"{root}/_{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as out:
                    pq.write_table(pa.Table.from_pylist([{"_digest": d, **{n: a.get(n) for n in schema.names[1:]}} for d, a in answers.items()], shape), out)
                files.move(draft, where)
            yield pd.DataFrame({"n": [len(answers)]})

    placed = missing.repartition(calls_at_once, "_digest").sortWithinPartitions("_digest")
    placed.mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()
    answers = _answered(df, store, result).withColumnRenamed("_digest", "_d")
    return rows.join(answers, F.col("_digest") == F.col("_d"), "left").drop("_digest", "_d")


def _cut(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Frames of n rows, the last may have fewer, whatever the sizes that come."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        held = pdf if held is None or held.empty else pd.concat([held, pdf], ignore_index=True)
        while len(held) >= n:
            yield held.iloc[:n]
            held = held.iloc[n:]
    if held is not None and len(held):
        yield held
