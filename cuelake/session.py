"""Session with the settings the library's results rest on: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

#: State of streams with timers can't be kept in any other store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword settings use __ for a dot (spark__ui__enabled="false")."""
    b = SparkSession.builder.appName("cuelake").config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (b.master(master) if master else b).getOrCreate()


@dataclass
class Config:
    """Settings of a run; an environment variable CUELAKE_<NAME> sets what the caller leaves out."""

    service_url: str = field(default="http://localhost:8000")
    window: int = field(default=10)
    retries: int = field(default=3)
    checkpoint_every: int = field(default=5)

    @classmethod
    def of(cls, **given: str | int) -> Config:
        env = {f.name: type(f.default)(os.environ[name]) for f in fields(cls) if (name := f"CUELAKE_{f.name.upper()}") in os.environ}
        return cls(**env | given)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether path, on any file system that Spark reads, is there and a file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(files.exists(where) and files.getFileStatus(where).isFile())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a local one is made for a local master without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="cuelake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read from it again: computed once, whatever is done with it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
