"""Command line: python -m cuelake srt|check|segment. Ends with 0, 1 after an error, 130 if broken off."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cues, segment
from .operators.providers import EnergyVad
from .operators.resample import resample
from .session import session
from .sources import documents, srt, wav_files

log = logging.getLogger("cuelake")


def _cues(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    return srt.read_srt(spark, path, dialect).withColumn("cue_id", F.col("ord"))


def run_srt(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cleans, merges and numbers the cues of all files under a path; one folder per file under the output."""
    srt.write_srt(srt.render_srt(_cues(spark, a.source, a.dialect), merge=not a.no_merge), a.output)


def run_check(spark: SparkSession, a: argparse.Namespace) -> None:
    """Writes the timing issues of all files under a path as JSON lines."""
    cues.timing_issues(_cues(spark, a.source, a.dialect)).write.mode("overwrite").json(a.output)


def run_segment(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cuts the speech out of all WAV files under a path: files in output/fragments, timelines in output/timelines."""
    pieces = resample(wav_files.mono(wav_files.read_pieces(spark, a.source)), a.sample_rate)
    vad = EnergyVad(a.threshold, a.min_speech_ms, a.min_silence_ms)
    spans = segment.segment_audio(pieces, vad, a.chunk_ms)
    files = f"{a.output}/fragments"
    listing = f"{a.output}/listing"
    segment.write_fragments(segment.cut_fragments(pieces, spans, a.chunk_ms), files).write.mode("overwrite").parquet(listing)
    total = F.floor(F.max(F.col("first_sample") + F.size("pcm")) * 1000 / F.first("sample_rate"))
    media = pieces.groupBy("media_id").agg(total.alias("total_ms"), F.first("sample_rate").alias("sample_rate"))
    media = media.select("media_id", F.col("media_id").alias("input_file"), "total_ms", "sample_rate", F.lit(files).alias("output_dir"))
    timelines = documents.timeline_json(spark.read.parquet(listing), media, export=True)
    timelines.select(F.url_encode("media_id").alias("media"), F.col("json").alias("value")).write.mode("overwrite").partitionBy("media").text(f"{a.output}/timelines")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cuelake")
    p.add_argument("--master", help="Spark master; left out, the one that spark-submit gives")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name, run in (("srt", run_srt), ("check", run_check), ("segment", run_segment)):
        c = sub.add_parser(name, help=run.__doc__)
        c.set_defaults(run=run)
        c.add_argument("source")
        c.add_argument("output")
        if name != "segment":
            c.add_argument("--dialect", choices=("strict", "lenient"), default="lenient")
    sub.choices["srt"].add_argument("--no-merge", action="store_true", help="leave short cues as they are")
    for flag, default in (("--sample-rate", 16_000), ("--chunk-ms", 30_000), ("--min-speech-ms", 250), ("--min-silence-ms", 300)):
        sub.choices["segment"].add_argument(flag, type=int, default=default)
    sub.choices["segment"].add_argument("--threshold", type=float, default=0.02)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(levelname)s %(message)s")
    try:
        a.run(spark or session(a.master), a)
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        log.error("%s failed: %s", a.command, e, exc_info=a.verbose)
        return 1
    log.info("%s: written to %s", a.command, a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
