"""Cutting timelines into chunks, and stitching what was cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import touches_chunk_end
from .ordered import running_sum, with_previous

CHUNK_MS, EDGE_MS, GAP_MS = 30_000, 100, 500
#: Segments of a medium are stitched in stretches of so much time, which bounds the rows of a task.
STRETCH_MS = 6 * 3600 * 1000


def chunk_bounds(media: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """media_id, chunk_no, start_ms, end_ms of fixed chunks over [0, total_ms); the last may be shorter."""
    n = F.ceil(F.col("total_ms") / chunk_ms).cast("bigint")
    rows = media.where("total_ms > 0").select("media_id", "total_ms", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk_no"))
    start = F.col("chunk_no") * chunk_ms
    return rows.select("media_id", "chunk_no", start.alias("start_ms"), F.least(start + chunk_ms, "total_ms").alias("end_ms"))


def sample_chunks(media: DataFrame, chunk_s: int = 300) -> DataFrame:
    """media_id, chunk_no, first_sample, n_samples: chunks of whole seconds for a splitter."""
    size = F.col("sample_rate").cast("bigint") * chunk_s
    rows = media.where("n_samples > 0").select("media_id", "n_samples", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n_samples") / size).cast("bigint") - 1)).alias("chunk_no"))
    at = F.col("chunk_no") * F.col("size")
    return rows.select("media_id", "chunk_no", at.alias("first_sample"), F.least("size", F.col("n_samples") - at).alias("n_samples"))


def cut_at_chunks(spans: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Spans cut at chunk borders: media_id, chunk_no, start_ms, end_ms. Empty spans vanish."""
    first, last = F.floor(F.col("start_ms") / chunk_ms), F.floor((F.col("end_ms") - 1) / chunk_ms)
    rows = spans.where("end_ms > start_ms").select("media_id", "start_ms", "end_ms", F.explode(F.sequence(first, last)).alias("chunk_no"))
    low = F.col("chunk_no") * chunk_ms
    return rows.select("media_id", "chunk_no", F.greatest("start_ms", low).alias("start_ms"), F.least("end_ms", low + chunk_ms).alias("end_ms"))


def incomplete(segments: DataFrame, chunk_ms: int = CHUNK_MS, edge_ms: int = EDGE_MS) -> DataFrame:
    """segments (media_id, chunk_no, start_ms, end_ms) with is_incomplete: whether it ends at its chunk's end."""
    return segments.withColumn("is_incomplete", touches_chunk_end(F.col("end_ms"), (F.col("chunk_no") + 1) * chunk_ms, edge_ms))


def _opens(prev_end: Column, prev_chunk: Column, chunk_ms: int, edge_ms: int, gap_ms: int) -> Column:
    """Whether a segment starts a span of its own: unless the one before reached the end of the chunk before it and
    this one starts within gap_ms of its own chunk's start."""
    goes_on = (prev_chunk + 1 == F.col("chunk_no")) & touches_chunk_end(prev_end, F.col("chunk_no") * chunk_ms, edge_ms) & (F.col("start_ms") - F.col("chunk_no") * chunk_ms < gap_ms)
    return F.when(goes_on, 0).otherwise(1)


def stitch(segments: DataFrame, chunk_ms: int = CHUNK_MS, edge_ms: int = EDGE_MS, gap_ms: int = GAP_MS) -> DataFrame:
    """media_id, frag_id (0-based), start_ms, end_ms, n_parts: segments found chunk by chunk, joined across borders.

    Speech longer than a chunk is joined over as many chunks as it has; chunks only move forward, so every input
    comes to an end. Segments of one medium are ordered by (start_ms, end_ms).
    """
    rows = segments.select("media_id", "chunk_no", "start_ms", "end_ms")
    stretch = F.floor(F.col("start_ms") / STRETCH_MS)
    ends = F.struct(F.col("end_ms").alias("end_ms"), F.col("chunk_no").alias("chunk_no"))
    rows = with_previous(rows.withColumn("_ends", ends), ["media_id"], ["start_ms", "end_ms"], stretch, "_ends", "_prev")
    opens = _opens(F.col("_prev.end_ms"), F.col("_prev.chunk_no"), chunk_ms, edge_ms, gap_ms)
    rows = running_sum(rows, ["media_id"], ["start_ms", "end_ms"], F.floor(F.col("start_ms") / STRETCH_MS), opens, "frag_id").withColumn("frag_id", F.col("frag_id") - 1)
    return rows.groupBy("media_id", "frag_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_parts"))
