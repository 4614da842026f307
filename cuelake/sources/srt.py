"""SRT files as tables of cues, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip
from ..functions.timecode import format_timecode, parse_timecode
from ..operators.cues import merge_short, number_cues


ARROW = "-->"


def parse_srt(files: DataFrame, dialect: str = "strict", mode: str = "drop") -> DataFrame:
    """files (track, content) as cues: track, ord (0-based place in the file), cue_index, start_ms, end_ms, text, lines.

    strict: entries part at blank lines, the index is a whole number, the times are exact up to what follows the
    end. lenient: any line ends, lines of white space part entries too, an index may have something after it, and
    times are searched for within the line. Entries of fewer than three lines or with unreadable numbers are
    dropped; with mode "permissive" they stay, with nulls and the entry in column corrupt. A null content has no entry.
    """
    content = F.col("content")
    if dialect == "lenient":
        content = F.regexp_replace(F.regexp_replace(content, "\r\n", "\n"), "\r", "\n")
        content = F.regexp_replace(content, r"\x{FEFF}", "")
    parted = F.split(strip(content), r"\n\s*\n" if dialect == "lenient" else r"\n\n+", -1)
    rows = files.where("content is not null").select("track", F.posexplode(parted).alias("ord", "entry")).withColumn("entry", strip(F.col("entry"))).where("entry <> ''")
    lines = F.split(F.col("entry"), "\n", -1)
    rows = rows.withColumn("all", lines)
    head, times = F.get("all", F.lit(0)), F.get("all", F.lit(1))
    if dialect == "lenient":
        index = F.regexp_extract(head, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")
        # a match can only begin where a word does
        pattern = r"(?<!\S)(\S+)\s*-->\s*(\S+)"
        codes = (F.regexp_extract(times, pattern, 1), F.regexp_extract(times, pattern, 2))
    else:
        index = F.when(strip(head).rlike(r"^[+-]?[0-9]+$"), strip(head).try_cast("bigint"))
        at = F.instr(times, F.lit(ARROW))
        before, after = strip(F.when(at > 1, F.substring(times, F.lit(1), at - 1))), strip(F.when(at > 1, F.substring(times, at + len(ARROW), F.length(times))))
        codes = (F.regexp_extract(before, r"^(.+)\z", 1), F.regexp_extract(after, r"^(.+)", 1))
    start, end = (parse_timecode(strip(c), dialect) for c in codes)
    rows = rows.select("track", F.col("ord").cast("bigint").alias("ord"), index.alias("cue_index"), start.alias("start_ms"), end.alias("end_ms"), "all", "entry")
    good = (F.size("all") >= 3) & F.col("cue_index").isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    body = F.slice("all", 3, F.greatest(F.size("all") - 2, F.lit(0)))
    out = [F.when(good, c).alias(n) for n, c in (("cue_index", F.col("cue_index")), ("start_ms", F.col("start_ms")), ("end_ms", F.col("end_ms")), ("text", F.array_join(body, "\n")), ("lines", body))]
    if mode == "permissive":
        return rows.select("track", "ord", *out, F.when(~good, F.col("entry")).alias("corrupt"))
    return rows.where(good).select("track", "ord", *out)


def read_srt(spark: SparkSession, path: str, dialect: str = "strict", mode: str = "drop") -> DataFrame:
    """All SRT files under a path; track is the file's path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("track"), F.col("value").alias("content"))
    return parse_srt(files, dialect, mode)


def entry(number: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    """One entry with its line end: number, times, cleaned text."""
    return F.concat(number.cast("string"), F.lit("\n"), format_timecode(start_ms), F.lit(" --> "), format_timecode(end_ms), F.lit("\n"), clean_text(text), F.lit("\n"))


def srt_entries(cues: DataFrame, merge: bool = True) -> DataFrame:
    """track, number, entry: short cues merged (if asked for), the rest in order of start and numbered from 1."""
    rows = merge_short(cues) if merge else cues.select("track", "start_ms", "end_ms", "text", "cue_id")
    return number_cues(rows).select("track", "number", entry(F.col("number"), F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("entry"))


def render_srt(cues: DataFrame, merge: bool = True) -> DataFrame:
    """track, content: a file's whole text per track. A track is one file here, and must fit a row."""
    per = srt_entries(cues, merge).groupBy("track").agg(F.sort_array(F.collect_list(F.struct("number", "entry"))).alias("e"))
    return per.select("track", F.array_join(F.transform("e", lambda x: x["entry"]), "\n").alias("content"))


def render_as_parsed(cues: DataFrame) -> DataFrame:
    """track, content with the indices, order and texts that the cues have: neither merged nor sorted nor cleaned."""
    one = F.concat(F.col("cue_index").cast("string"), F.lit("\n"), format_timecode(F.col("start_ms"), clamp=False), F.lit(" --> "), format_timecode(F.col("end_ms"), clamp=False), F.lit("\n"), F.col("text"), F.lit("\n"))
    per = cues.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("ord", one.alias("entry")))).alias("e"))
    return per.select("track", F.array_join(F.transform("e", lambda x: x["entry"]), "\n").alias("content"))


def write_srt(rendered: DataFrame, path: str) -> None:
    """One folder of text per track under path (track=.../), written by the executors; an older one is replaced."""
    rendered.select("track", F.col("content").alias("value")).write.mode("overwrite").partitionBy("track").text(path)


def write_srt_parts(cues: DataFrame, path: str, merge: bool = True) -> None:
    """As write_srt of render_srt, for tracks of any length: a folder per track (track=.../) of text parts.

    Entries are dealt by ranges of (track, number), so a long track is many tasks. In order of their names the parts of a
    track are what write_srt writes, byte by byte.
    """
    n = int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = srt_entries(cues, merge).repartitionByRange(n, "track", "number").sortWithinPartitions("track", "number")
    rows.select("track", F.col("entry").alias("value")).write.mode("overwrite").partitionBy("track").text(path)
