"""Audio in rows: down-mixing, resampling, joining, mixing down onto a timeline."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_sum

#: Samples of one output frame of a mix-down: what a task holds, whatever the length of the medium.
FRAME = 1 << 16


def to_mono(x: np.ndarray, channels: int) -> np.ndarray:
    return x if channels == 1 else x.reshape(-1, channels).mean(axis=1, dtype=np.float64).astype(np.float32)


def resampled(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Band-limited resampling by the discrete Fourier transform to int(len * target / source) samples."""
    n, m = len(x), len(x) * target // source
    if source == target or not n or not m:
        return x[:m] if source != target else x
    half = min(n, m)
    spectrum = np.fft.rfft(x.astype(np.float64))[: half // 2 + 1]
    if half % 2 == 0 and n != m:
        spectrum[half // 2] *= 2 if m < n else 0.5
    return (np.fft.irfft(spectrum, m) * (m / n)).astype(np.float32)


def conform(audio: DataFrame, sample_rate: int) -> DataFrame:
    """audio (media_id, ord, start_ms, sample_rate, channels, pcm) in mono at one sample rate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["pcm"] = [resampled(to_mono(np.asarray(p, np.float32), int(c)), int(r), sample_rate) for p, c, r in zip(pdf["pcm"], pdf["channels"], pdf["sample_rate"])]
            pdf["sample_rate"] = sample_rate
            yield pdf[["media_id", "ord", "start_ms", "sample_rate", "pcm"]]

    return audio.select("media_id", "ord", "start_ms", "sample_rate", "channels", "pcm").mapInPandas(run, "media_id string, ord bigint, start_ms bigint, sample_rate int, pcm array<float>")


def mix_down(audio: DataFrame, media: DataFrame, frame: int = FRAME) -> DataFrame:
    """media_id, frame_no, pcm: segments (media_id, ord, start_ms, sample_rate, pcm) placed on the timeline.

    A later segment (by ord) overwrites earlier ones; what lies outside [0, total) is cut off; silence is zero.
    media: media_id, total_ms, sample_rate. Every frame is one group, so a long medium is many tasks. Frames
    without any segment are silent. Segments meet their medium only in its frames: a join on media_id would put all of a
    medium in one task.
    """
    size = F.floor(F.col("total_ms") * F.col("sample_rate") / 1000).cast("bigint")
    total = media.select("media_id", size.alias("total"))
    frames = total.where("total > 0").select("media_id", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / frame))).alias("frame_no"))
    at = F.floor(F.col("start_ms") * F.col("sample_rate") / 1000).cast("bigint")
    n = F.size("pcm")
    placed = audio.where("media_id is not null").select("media_id", "ord", at.alias("at"), "pcm")
    first, last = F.floor(F.greatest("at", F.lit(0)) / frame), F.floor((F.col("at") + n - 1) / frame)

    def piece(no):
        """What of a segment lies in a frame, cut out before rows multiply."""
        low = F.greatest(no * frame - F.col("at"), F.lit(0)).cast("int")
        high = F.least((no + 1) * frame - F.col("at"), n).cast("int")
        return F.struct(no.alias("frame_no"), (F.col("at") + low - no * frame).alias("offset"), F.slice("pcm", low + 1, high - low).alias("part"))

    # no filter on pcm: it would be pushed down, and what makes the samples would run once more for each condition
    cut = F.when((n > 0) & (F.col("at") + n > 0), F.transform(F.sequence(first, last), piece))
    pieces = placed.select("media_id", "ord", F.explode(cut).alias("p")).select("media_id", "p.frame_no", "ord", "p.offset", "p.part")

    def lay(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["media_id", "frame_no"]).append_column("pcm", pa.array([], pa.list_(pa.float32())))
        no, total = left["frame_no"][0].as_py(), left["total"][0].as_py()
        out = np.zeros(min(frame, total - no * frame), np.float32)
        parts = [(c.values.to_numpy(zero_copy_only=False), low, high) for c in right["part"].chunks for low, high in pairwise(c.offsets.to_pylist())]
        offsets = right["offset"].to_pylist()
        for i in pc.sort_indices(right, [("ord", "ascending")]).to_pylist():
            o, (x, low, high) = offsets[i], parts[i]
            high = max(min(high, low + len(out) - o), low)
            out[o : o + high - low] = x[low:high]
        pcm = pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))
        return left.select(["media_id", "frame_no"]).slice(0, 1).append_column("pcm", pcm)

    keys = ["media_id", "frame_no"]
    return frames.groupBy(*keys).cogroup(pieces.groupBy(*keys)).applyInArrow(lay, "media_id string, frame_no bigint, pcm array<float>")


def overlay_samples(spans: DataFrame) -> DataFrame:
    """media_id, sample, value: the last writer's value at each sample that a span (media_id, ord, first, last, value) covers.

    A row per sample: for short spans. overlay.overlay_runs has the same as intervals; dense audio goes through mix_down.
    """
    rows = spans.where("last >= first").select("media_id", "ord", "value", F.explode(F.sequence("first", "last")).alias("sample"))
    return rows.groupBy("media_id", "sample").agg(F.max_by("value", "ord").alias("value"))


def concat_chunks(chunks: DataFrame) -> DataFrame:
    """media_id, pcm: chunks (media_id, chunk_no, pcm) in order; null if any chunk failed (has no pcm)."""
    per = chunks.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", F.coalesce("pcm", F.array().cast("array<float>")).alias("pcm")))).alias("c"), F.bool_and(F.col("pcm").isNotNull()).alias("ok"))
    return per.select("media_id", F.when(F.col("ok"), F.flatten(F.transform("c", lambda x: x["pcm"]))).alias("pcm"))


def concat_pieces(chunks: DataFrame, per_block: int = 256) -> DataFrame:
    """media_id, chunk_no, first_sample, pcm: where each chunk (media_id, chunk_no, pcm) lies in its medium, in order of chunk_no.

    As concat_chunks without a row per medium: all or nothing, so a medium of which a chunk failed (has no pcm) has no rows.
    Chunks of one number lie in order of their samples; a null media_id is a medium. No task holds more than
    per_block chunk numbers of a medium at once.
    """
    failed = chunks.where("pcm is null").select(F.col("media_id").alias("_m")).distinct()
    rows = chunks.select("media_id", "chunk_no", "pcm").where("pcm is not null").join(failed, F.col("media_id").eqNullSafe(F.col("_m")), "left_anti")
    n = F.size("pcm").cast("bigint")
    rows = running_sum(rows, ["media_id"], ["chunk_no", "pcm"], F.floor(F.col("chunk_no") / per_block), n, "_end")
    return rows.select("media_id", "chunk_no", (F.col("_end") - n).alias("first_sample"), "pcm")


def durations(segments: DataFrame) -> DataFrame:
    """media_id, total_ms (the last end), n_rates, rates: for media whose own length isn't known, and a check of their rates."""
    return segments.groupBy("media_id").agg(F.max("end_ms").alias("total_ms"), F.count_distinct("sample_rate").alias("n_rates"), F.sort_array(F.collect_set("sample_rate")).alias("rates"))
