"""Helpers shared by the corpus operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the controls TAB to CR.
SPACE = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A table of more bytes than this that comes in fewer splits than there are cores is dealt out to all cores.
SPREAD_BYTES = 4 << 20
#: A side of a join goes to every task only if it was measured, and has at most so many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies there. A file of one row group would else be read, and all that follows done, by one core."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    large = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES
    return df.repartition(cores) if large and df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, size: int) -> DataFrame:
    """df, to be broadcast if its measured size in bytes is within the bound; beyond it the same join shuffles."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A local one is made only for a local master without that setting, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="cuelake-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: What is to be done when the innermost open scope() closes.
_scopes: list[list[Callable[[], None]]] = []


def at_close(done: Callable[[], None]) -> None:
    """Runs done when the scope around closes; without one, what an operator wrote stays in the shared folder."""
    if _scopes:
        _scopes[-1].append(done)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Owns the tables that operators write meanwhile and deletes them at its end.

    A result that reads them must be written by then: the function that comes with the scope writes a table as written()
    does, which outlives it.
    """

    def outside(df: DataFrame, name: str) -> DataFrame:
        inner = _scopes.pop()
        try:
            return written(df, name)
        finally:
            _scopes.append(inner)

    _scopes.append([])
    try:
        yield outside
    finally:
        for done in reversed(_scopes.pop()):
            done()


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read from it again: its lineage ends there."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    at_close(lambda: delete_folder(spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and nothing will read again."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            delete_folder(t.sparkSession, folder)


def utf8(text: Column) -> Column:
    """The bytes of a text: what goes to Python, so that bytes that are no UTF-8 don't end a job there."""
    return text.cast("binary")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body (or a lambda in it) names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words of [^\\x20\\x09-\\x0D]+; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; a missing one is null. Other columns, whatever their names, can't clash with an operator's own."""
    kinds = {"doc_id": "bigint", "page_id": "bigint", "conv_id": "bigint", "turn": "int", "n_chars": "bigint"}
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None).cast(kinds.get(n, "string"))).alias(n) for n in names])


def text_key(text: Column, h: str = "text_h", n: str = "text_n") -> list[Column]:
    """Tells texts apart: a hash and the length in bytes (null: -1), as two columns of these names."""
    return [F.xxhash64(text).alias(h), F.coalesce(F.octet_length(text), F.lit(-1)).alias(n)]


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
