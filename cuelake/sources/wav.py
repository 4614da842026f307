"""WAV files as rows of samples, and back: 16-bit and 8-bit PCM, 32-bit PCM and float."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "media_id string, sample_rate int, channels int, n_samples bigint, pcm array<float>"


@dataclass(frozen=True)
class WavHead:
    """Where a file's samples are, and what they are."""

    sample_rate: int
    channels: int
    kind: int
    bits: int
    at: int
    n_frames: int

    @property
    def frame(self) -> int:
        """Bytes of a frame, one sample per channel."""
        return self.channels * self.bits // 8

    def samples(self, data: bytes) -> np.ndarray:
        """Whole frames as frames x channels, float32 from -1 to 1."""
        data = data[: len(data) // self.frame * self.frame]
        if self.kind == 3 and self.bits == 32:
            x = np.frombuffer(data, "<f4")
        elif self.kind == 1 and self.bits == 16:
            x = np.frombuffer(data, "<i2") / np.float32(32768)
        elif self.kind == 1 and self.bits == 32:
            x = (np.frombuffer(data, "<i4") / 2147483648.0).astype(np.float32)
        elif self.kind == 1 and self.bits == 8:
            x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / np.float32(128)
        else:
            raise ValueError(f"{self.bits}-bit samples of kind {self.kind} are not supported")
        return x.reshape(-1, self.channels).astype(np.float32)


def wav_head(read_at: Callable[[int, int], bytes], size: int) -> WavHead:
    """The head of a file of so many bytes. Chunks may come in any order; samples that the file no longer holds don't count."""
    first = read_at(0, 12)
    if first[:4] not in (b"RIFF", b"RF64") or first[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data, large = 12, None, None, None
    while at + 8 <= size and not (form and data):
        name, n = struct.unpack("<4sI", read_at(at, 8))
        if name == b"ds64":
            large = struct.unpack("<Q", read_at(at + 16, 8))[0]
        elif name == b"fmt ":
            raw = read_at(at + 8, min(n, 40))
            form = struct.unpack_from("<HHIIHH", raw)
            if form[0] == 0xFFFE and len(raw) >= 26:  # the kind is the beginning of a longer name
                form = (struct.unpack_from("<H", raw, 24)[0], *form[1:])
        elif name == b"data":
            n = size - at - 8 if n == 0xFFFFFFFF and large is None else large if n == 0xFFFFFFFF else n
            data = (at + 8, min(n, size - at - 8))
        at += 8 + n + (n & 1)
    if not form or not data:
        raise ValueError("no samples")
    kind, channels, rate, _, _, bits = form
    if not channels or not rate or bits % 8 or not bits:
        raise ValueError("a head without channels, rate or bits")
    return WavHead(rate, channels, kind, bits, data[0], data[1] // (channels * bits // 8))


def decode_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (frames x channels, float32 from -1 to 1)."""
    head = wav_head(lambda at, n: raw[at : at + n], len(raw))
    return head.sample_rate, head.samples(raw[head.at : head.at + head.n_frames * head.frame])


def pcm16(samples: np.ndarray) -> bytes:
    """16-bit PCM; samples beyond -1 and 1 are clipped."""
    return np.clip(np.round(np.asarray(samples, np.float64) * 32767), -32768, 32767).astype("<i2").tobytes()


def mono_head(n_bytes: int, sample_rate: int) -> bytes:
    """The head of a file of mono 16-bit PCM."""
    if n_bytes > 0xFFFFFFFF - 36:
        raise ValueError("more samples than a WAV file can hold")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n_bytes, b"WAVE", b"fmt ", 16, 1, 1, sample_rate, sample_rate * 2, 2, 16, b"data", n_bytes)


def encode_wav(samples: np.ndarray, sample_rate: int) -> bytes:
    """Mono 16-bit PCM; samples beyond -1 and 1 are clipped."""
    pcm = pcm16(samples)
    return mono_head(len(pcm), sample_rate) + pcm


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """media_id (the path), sample_rate, channels, n_samples, pcm (frames in order, channels interleaved): small files whole.

    Files of any size come in pieces by wav_files.read_pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"]):
                rate, x = decode_wav(bytes(raw))
                rows.append((name, rate, x.shape[1], len(x), x.reshape(-1)))
            yield pd.DataFrame(rows, columns=["media_id", "sample_rate", "channels", "n_samples", "pcm"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def encoded(audio: DataFrame) -> DataFrame:
    """audio (media_id, sample_rate, pcm) as media_id, wav binary."""

    @F.pandas_udf("binary")
    def wav(pcm: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else encode_wav(p, int(r)) for p, r in zip(pcm, rate)])

    return audio.select("media_id", wav("pcm", "sample_rate").alias("wav"))
