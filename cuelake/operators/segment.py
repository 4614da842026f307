"""From audio to fragments: chunks, a speech detector over them, spans joined across borders, pieces cut out, files.

Audio is rows (media_id, first_sample, sample_rate, pcm): consecutive pieces of a medium, of any size, so no medium has
to fit a row. A task holds chunks and fragments only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import fragment_name
from ..functions.timecode import sample_index
from ..sources.wav import encode_wav
from .providers import EnergyVad, Provider, enrich
from .timeline import CHUNK_MS, EDGE_MS, GAP_MS, stitch


def _chunk_size(chunk_ms: int) -> Column:
    """Samples of a chunk. A chunk of no whole number of samples is an error, as its times would drift."""
    n = F.col("sample_rate").cast("bigint") * chunk_ms
    return F.when((n > 0) & (n % 1000 == 0), F.floor(n / 1000)).otherwise(F.raise_error(F.lit(f"{chunk_ms} ms are no whole number of samples")).cast("bigint"))


def _joined_parts(parts: Column) -> Column:
    """Samples of collected structs (place, part) in order of place."""
    return F.flatten(F.transform(F.sort_array(parts), lambda x: x["part"]))


def audio_chunks(audio: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """media_id, chunk_no, sample_rate, pcm: audio cut anew into fixed chunks; the last of a medium may be shorter.

    Null or empty pieces have no samples. What no piece covers is left out, not silent.
    """
    rows = audio.where(F.size("pcm") > 0).select("media_id", "first_sample", "sample_rate", "pcm", _chunk_size(chunk_ms).alias("n"))
    at = F.col("first_sample")
    first, last = F.floor(at / F.col("n")), F.floor((at + F.size("pcm") - 1) / F.col("n"))

    def piece(no: Column) -> Column:
        low = F.greatest(no * F.col("n") - at, F.lit(0)).cast("int")
        high = F.least((no + 1) * F.col("n") - at, F.size("pcm")).cast("int")
        return F.struct(no.alias("chunk_no"), (at + low).alias("place"), F.slice("pcm", low + 1, high - low).alias("part"))

    pieces = rows.select("media_id", "sample_rate", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    per = pieces.groupBy("media_id", F.col("p.chunk_no").alias("chunk_no"), "sample_rate").agg(F.collect_list(F.struct("p.place", "p.part")).alias("parts"))
    return per.select("media_id", "chunk_no", "sample_rate", _joined_parts(F.col("parts")).alias("pcm"))


def detect(chunks: DataFrame, detector: Provider | None = None, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """media_id, chunk_no, start_ms, end_ms of the speech that a detector finds in each chunk. A failed call is an error."""
    found = enrich(chunks.select("media_id", "chunk_no", "sample_rate", "pcm"), detector or EnergyVad(), ["pcm", "sample_rate"], "starts array<bigint>, ends array<bigint>")
    starts = F.coalesce("starts", F.raise_error(F.lit("the speech detector failed")).cast("array<bigint>"))
    rows = found.select("media_id", "chunk_no", F.explode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("x"))
    base = F.col("chunk_no") * chunk_ms
    return rows.select("media_id", "chunk_no", (base + F.col("x")["s"]).alias("start_ms"), (base + F.col("x")["e"]).alias("end_ms"))


def segment_audio(audio: DataFrame, detector: Provider | None = None, chunk_ms: int = CHUNK_MS, edge_ms: int = EDGE_MS, gap_ms: int = GAP_MS) -> DataFrame:
    """media_id, frag_id, start_ms, end_ms, n_parts: the speech of whole media. The detector carries its own settings."""
    return stitch(detect(audio_chunks(audio, chunk_ms), detector, chunk_ms), chunk_ms, edge_ms, gap_ms)


def cut_fragments(audio: DataFrame, spans: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """media_id, frag_id, start_ms, end_ms, file, sample_rate, pcm: the samples from a span's start up to before its end.

    Spans meet the chunks they touch by an equality join; what lies beyond the audio is cut off, and a span without any
    sample gives no row. File names carry milliseconds and id, with media_id made safe for a path.
    """
    touched = F.sequence(F.floor(F.greatest("start_ms", F.lit(0)) / chunk_ms), F.floor((F.col("end_ms") - 1) / chunk_ms))
    wanted = spans.where("end_ms > start_ms and end_ms > 0").select("media_id", "frag_id", "start_ms", "end_ms", F.explode(touched).alias("chunk_no"))
    rows = wanted.join(audio_chunks(audio, chunk_ms), ["media_id", "chunk_no"])
    base = F.col("chunk_no") * _chunk_size(chunk_ms)
    low = F.greatest(sample_index(F.col("start_ms"), F.col("sample_rate")) - base, F.lit(0)).cast("int")
    high = F.least(sample_index(F.col("end_ms"), F.col("sample_rate")) - base, F.size("pcm")).cast("int")
    part = F.slice("pcm", low + 1, F.greatest(high - low, F.lit(0))).alias("part")
    per = rows.select("media_id", "frag_id", "start_ms", "end_ms", "sample_rate", F.struct(F.col("chunk_no").alias("place"), part).alias("p"))
    per = per.groupBy("media_id", "frag_id", "start_ms", "end_ms", "sample_rate").agg(F.collect_list("p").alias("parts"))
    file = fragment_name(F.url_encode("media_id"), F.col("frag_id"), F.col("start_ms"), F.col("end_ms")).alias("file")
    return per.select("media_id", "frag_id", "start_ms", "end_ms", file, "sample_rate", _joined_parts(F.col("parts")).alias("pcm")).where(F.size("pcm") > 0)


def write_fragments(fragments: DataFrame, directory: str) -> DataFrame:
    """Writes fragments as WAV files when the result (media_id, frag_id, start_ms, end_ms, file, n_bytes) is computed.

    Executors write, so directory must be one that all share. A file is put in its place whole; a task that runs
    again puts the same bytes there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory) if ":/" in directory else (fs.LocalFileSystem(), directory)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            sizes = []
            for file, pcm, rate in zip(pdf["file"], pdf["pcm"], pdf["sample_rate"]):
                raw, part = encode_wav(pcm, int(rate)), f"{root}/.{file}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(raw)
                store.move(part, f"{root}/{file}")
                sizes.append(len(raw))
            yield pdf[["media_id", "frag_id", "start_ms", "end_ms", "file"]].assign(n_bytes=sizes)

    kinds = dict(fragments.dtypes)
    return fragments.mapInPandas(run, f"media_id {kinds['media_id']}, frag_id bigint, start_ms bigint, end_ms bigint, file string, n_bytes bigint")
