"""WAV files of any size: a data source that reads byte ranges as pieces, and one that writes in two phases.

Reading plans partitions from file sizes alone. A task finds the head of its file itself and returns the frames that begin
in its range, so a file of any length is many tasks and no task holds more than a piece.

Writing: tasks append the samples of their rows to one part file each, beside an index of what lies where in it. The commit
publishes the list of parts of the tasks that came through; what others left is never looked at. A second
job puts a head and the parts of a medium together, in order, as one file, in steps of a megabyte, and moves it to its
place whole. Samples never pass the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .store import files_under, store_of
from .wav import mono_head, pcm16, wav_head

NAME = "wav"
SPLIT_BYTES, PIECE_FRAMES, COPY_BYTES = 64 << 20, 1 << 18, 1 << 20
PIECES = "media_id string, first_sample bigint, sample_rate int, channels int, pcm array<float>"
LISTING = "media_id string, file string, sample_rate int, n_samples bigint, n_bytes bigint, sha256 string"


@dataclass
class Range(InputPartition):
    path: str
    size: int
    low: int
    high: int


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.piece = int(options.get("pieceframes", PIECE_FRAMES))

    def partitions(self) -> list[InputPartition]:
        return [Range(p, n, low, min(low + self.split, n)) for p, n in files_under(self.path, ".wav") for low in range(0, n, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, path = store_of(partition.path)
        with store.open_input_file(path) as file:
            head = wav_head(lambda at, n: file.read_at(n, at), partition.size)
            first = lambda byte: min(max(-(-(byte - head.at) // head.frame), 0), head.n_frames)  # noqa: E731  the first frame that begins there or later
            for f in range(first(partition.low), stop := first(partition.high), self.piece):
                n = min(self.piece, stop - f)
                x = head.samples(file.read_at(n * head.frame, head.at + f * head.frame)).reshape(-1)
                pcm = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([f], pa.int64()), pa.array([head.sample_rate], pa.int32()), pa.array([head.channels], pa.int32()), pcm], ["media_id", "first_sample", "sample_rate", "channels", "pcm"])


@dataclass
class Part(WriterCommitMessage):
    name: str


class WavWriter(DataSourceArrowWriter):
    """Phase one: parts, and at the commit their list."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = store_of(self.path)  # a task that outlives its job finds no folder any more
        name, at, rows = f"part-{uuid.uuid4().hex}", 0, []
        with store.open_output_stream(f"{root}/{name}.pcm") as out:
            for b in iterator:
                for media, first, rate, pcm in zip(*(b.column(c) for c in ("media_id", "first_sample", "sample_rate", "pcm"))):
                    raw = pcm16(pcm.values.to_numpy(zero_copy_only=False)) if pcm.is_valid else b""
                    out.write(raw)
                    rows.append((media.as_py(), first.as_py(), rate.as_py(), len(raw) // 2, name, at))
                    at += len(raw)
        index = pd.DataFrame(rows, columns=["media_id", "first_sample", "sample_rate", "n", "part", "at"]).astype({"first_sample": "int64", "sample_rate": "int32", "n": "int64", "at": "int64"})
        pq.write_table(pa.Table.from_pandas(index, preserve_index=False), f"{root}/{name}.index", filesystem=store)
        return Part(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.path)
        with store.open_output_stream(f"{root}/.commit") as out:
            out.write(json.dumps([m.name for m in messages if m]).encode())
        store.move(f"{root}/.commit", f"{root}/_committed")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        remove(self.path)


class WavSource(DataSource):
    """format("wav"). Options: path, splitBytes and pieceFrames for reading."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PIECES

    def reader(self, schema) -> WavReader:
        return WavReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WavWriter:
        store, root = store_of(self.options["path"])
        store.create_dir(root, recursive=True)
        return WavWriter({k.lower(): v for k, v in self.options.items()})


def remove(path: str) -> None:
    from pyarrow import fs

    store, root = store_of(path)
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)


def read_pieces(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, piece_frames: int = PIECE_FRAMES) -> DataFrame:
    """media_id (the path), first_sample, sample_rate, channels, pcm (channels interleaved): consecutive pieces of WAV files.

    A file without a frame has no piece; what is no WAV file is an error, and a file that was cut off gives what it has.
    """
    spark.dataSource.register(WavSource)
    return spark.read.format(NAME).option("splitBytes", split_bytes).option("pieceFrames", piece_frames).load(path)


def write_wav(pieces: DataFrame, directory: str) -> DataFrame:
    """One mono 16-bit file per medium from pieces (media_id, first_sample, sample_rate, pcm); media_id, file, sample_rate, n_samples, n_bytes, sha256 as a table.

    Pieces may come in any order, but must cover a medium from 0 without hole or overlap, at one rate, or the run fails and
    leaves no file of that medium. Empty and null pieces have no samples. directory is one that all executors share.
    """
    spark, parts = pieces.sparkSession, f"{directory.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    spark.dataSource.register(WavSource)
    try:
        pieces.select("media_id", "first_sample", "sample_rate", "pcm").write.format(NAME).mode("append").save(parts)
        store, root = store_of(parts)
        with store.open_input_stream(f"{root}/_committed") as f:
            names = json.loads(f.read())
        listing = f"{directory.rstrip('/')}/_listing-{uuid.uuid4().hex}"

        def assemble(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf[pdf["n"] > 0].sort_values("first_sample", kind="stable")
            rates, total = pdf["sample_rate"].unique(), int(pdf["n"].sum())
            if len(rates) > 1 or not np.array_equal(pdf["first_sample"].to_numpy(), np.concatenate(([0], pdf["n"].cumsum().to_numpy()[:-1]))[: len(pdf)]):
                raise ValueError(f"the pieces of {key[0]} don't cover it from its beginning at one rate")
            if not total:
                return pd.DataFrame([], columns=["media_id", "file", "sample_rate", "n_samples", "n_bytes", "sha256"])
            store, root = store_of(parts)
            _, target = store_of(directory)
            file, sha = f"{quote(str(key[0]), safe='')}.wav", hashlib.sha256()
            with store.open_output_stream(f"{root}/{file}.whole") as out:
                out.write(mono_head(total * 2, int(rates[0])))
                for part, run in pdf.groupby((pdf["part"] != pdf["part"].shift()).cumsum(), sort=False):
                    with store.open_input_file(f"{root}/{run['part'].iloc[0]}.pcm") as f:
                        for at, n in zip(run["at"], run["n"]):
                            for low in range(0, n * 2, COPY_BYTES):
                                raw = f.read_at(min(COPY_BYTES, n * 2 - low), at + low)
                                sha.update(raw)
                                out.write(raw)
            store.move(f"{root}/{file}.whole", f"{target.rstrip('/')}/{file}")
            return pd.DataFrame([(key[0], file, int(rates[0]), total, total * 2 + 44, sha.hexdigest())], columns=["media_id", "file", "sample_rate", "n_samples", "n_bytes", "sha256"])

        if names:
            index = spark.read.schema("media_id string, first_sample bigint, sample_rate int, n bigint, part string, at bigint").parquet(*[f"{parts}/{n}.index" for n in names])
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the index is small, but not what it stands for: media aren't to be gathered in one task
            index.repartition(n, "media_id").groupBy("media_id").applyInPandas(assemble, LISTING).write.parquet(listing)
        else:
            spark.createDataFrame([], LISTING).write.parquet(listing)
        return spark.read.schema(LISTING).parquet(listing)
    finally:
        remove(parts)


def mono(pieces: DataFrame) -> DataFrame:
    """media_id, first_sample, sample_rate, pcm: the mean of the channels."""

    @F.pandas_udf("array<float>")
    def mixed(pcm: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else np.asarray(p, np.float32).reshape(-1, int(c)).mean(axis=1, dtype=np.float64).astype(np.float32) for p, c in zip(pcm, channels)])

    return pieces.select("media_id", "first_sample", "sample_rate", F.when(F.col("channels") == 1, F.col("pcm")).otherwise(mixed("pcm", "channels")).alias("pcm"))
