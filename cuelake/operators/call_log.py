"""Refinement's progress as a log: a base, the calls since, and their merge on reading."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL = ("track", "call_seq", "name", "pos", "first_text", "second_text")


class CallLog:
    """A folder that all executors reach: base-N, the state after round N, and calls-N, the calls of round N.

    A folder counts once its write is complete (_SUCCESS), so what a lost run left half-written is as if it weren't there and
    is written over. What a base contains goes only when that base is complete. input_file tells runs apart.
    """

    def __init__(self, spark: SparkSession, path: str, input_file: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{re.sub(r'[^A-Za-z0-9._-]', lambda m: f'%{ord(m[0]):x}', input_file)}"

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _rounds(self, kind: str) -> list[int]:
        """Rounds whose folder of this kind is complete, in order."""
        files, root = self._hadoop(self.path)
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        found = sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}-(\d+)", n)))
        return [n for n in found if self._hadoop(f"{self._at(kind, n)}/_SUCCESS")[0].exists(self._hadoop(f"{self._at(kind, n)}/_SUCCESS")[1])]

    def _at(self, kind: str, n: int) -> str:
        return f"{self.path}/{kind}-{n:08d}"

    def begun(self) -> bool:
        return bool(self._rounds("base"))

    def begin(self, state: DataFrame) -> None:
        state.write.mode("overwrite").parquet(self._at("base", 0))

    def last(self) -> int:
        """The last round that is complete."""
        return max(self._rounds("base")[-1:] + self._rounds("calls")[-1:])

    def append(self, calls: DataFrame) -> int:
        """Writes a round's calls; its number."""
        n = self.last() + 1
        calls.select(*CALL).write.mode("overwrite").parquet(self._at("calls", n))
        return n

    def calls(self, after: int) -> DataFrame | None:
        """Calls of the rounds after this one; call_seq orders them over all rounds. None if there is no such round."""
        out = None
        for n in self._rounds("calls"):
            if n > after:
                rows = self.spark.read.parquet(self._at("calls", n)).withColumn("call_seq", F.struct(F.lit(n).alias("round"), F.col("call_seq").alias("seq")))
                out = rows if out is None else out.unionByName(rows)
        return out

    def state(self) -> DataFrame:
        """The state now: the last base with the calls after it. There are as many of those as rounds between two bases."""
        from .refine import apply_calls

        n = self._rounds("base")[-1]
        base, calls = self.spark.read.parquet(self._at("base", n)), self.calls(n)
        return base if calls is None else apply_calls(base, calls)

    def compact(self) -> None:
        """Makes the state now the base, and removes what it contains."""
        n = self.last()
        if self._rounds("base")[-1] < n:
            self.state().write.mode("overwrite").parquet(self._at("base", n))
        for kind, upto in (("base", n - 1), ("calls", n)):
            for k in self._rounds(kind):
                if k <= upto:
                    files, where = self._hadoop(self._at(kind, k))
                    files.delete(where, True)

    def remove(self) -> bool:
        """Removes the log, as after a run that came to its end. Whether there was one."""
        files, root = self._hadoop(self.path)
        return bool(files.delete(root, True))
