"""JSON timelines and checkpoints, and the HTML index of rendered files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import escape_html


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Fragments (media_id, frag_id, file, start_ms, end_ms) of timeline files of either shape: cache or export."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("media_id"), "value")
    cache, export = F.from_json("value", schema.TIMELINE), F.from_json("value", schema.EXPORT)
    rows = raw.select("media_id", F.explode(F.coalesce(cache["timeline"], export["fragments"])).alias("f"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return rows.select("media_id", F.col("f.id").alias("frag_id"), F.col("f.file").alias("file"), ms("f.start").alias("start_ms"), ms("f.end").alias("end_ms"))


def complete_timeline(fragments: DataFrame, files: DataFrame) -> DataFrame:
    """The fragments of media whose every file is listed (column file); one missing file drops its medium."""
    missing = fragments.join(files.select("file").distinct(), "file", "left_anti").select("media_id").distinct()
    return fragments.join(missing, "media_id", "left_anti")


def timeline_json(fragments: DataFrame, media: DataFrame, export: bool = False) -> DataFrame:
    """media_id, json in the shape of a cache or an export. media: media_id, input_file, total_ms, sample_rate, output_dir."""
    item = F.struct(F.col("frag_id").alias("id"), "file", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    per = fragments.groupBy("media_id").agg(F.sort_array(F.collect_list(item)).alias("timeline"))
    rows = media.join(per, "media_id", "left").withColumn("timeline", F.coalesce("timeline", F.from_json(F.lit("[]"), "array<struct<id:bigint,file:string,start:double,end:double>>")))
    facts = [F.col("input_file"), (F.col("total_ms") / 1000).alias("total_duration"), F.col("sample_rate"), F.size("timeline").alias("fragment_count"), F.col("output_dir")]
    whole = F.struct(*facts, F.col("timeline").alias("fragments")) if export else F.struct("timeline", F.struct(*facts).alias("metadata"), F.col("output_dir").alias("fragments_dir"))
    return rows.select("media_id", F.to_json(whole).alias("json"))


def html_index(files: DataFrame, listing: DataFrame, title: str = "Files") -> DataFrame:
    """page, html: an index page per page id with a card for every file (page, position, label, file) that is listed."""
    there = files.join(listing.select("file").distinct(), "file", "left_semi")
    card = F.concat(F.lit('<div class="card"><h3>'), escape_html(F.col("label")), F.lit('</h3><audio controls src="'), escape_html(F.col("file")), F.lit('"></audio></div>'))
    per = there.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("position", card.alias("card")))).alias("c"))
    body = F.array_join(F.transform("c", lambda x: x["card"]), "\n")
    return per.select("page", F.concat(F.lit(f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{title}</title></head><body>\n<p>'), F.size("c").cast("string"), F.lit(" files</p>\n"), body, F.lit("\n</body></html>\n")).alias("html"))
