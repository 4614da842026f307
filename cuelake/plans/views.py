"""Views of the supplied tables as cues, fragments, calls and so on, in Spark and in SQL.

Times are compressed a hundredfold, so that cue durations straddle the thresholds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cues import number_cues


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, cue_id, start_ms, end_ms, text, user_id: one cue per event."""
    e = table(spark, sf_dir, "events")
    start = F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01')) div 100000")
    return e.select(
        F.col("event_type").alias("track"), F.col("event_id").alias("cue_id"), start.alias("start_ms"), (start + F.round(F.col("value") * 10).cast("bigint")).alias("end_ms"),
        F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("text"), "user_id",
    )


CUES = """
cues as (
  select event_type as track, event_id as cue_id,
    (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 100000 as start_ms,
    (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 100000 + cast(round(value * 10) as bigint) as end_ms,
    event_type || ':' || event_id as text, user_id
  from events)
"""

#: The merged cues: shorts between two normal cues fold greedily, step by step.
MERGED = f"""
{CUES},
flagged as (select *, end_ms - start_ms < 500 as short, sum(case when end_ms - start_ms < 500 then 0 else 1 end) over (partition by track order by start_ms, cue_id rows unbounded preceding) as island from cues),
shorts as (select *, row_number() over (partition by track, island order by start_ms, cue_id) as i from flagged where short),
fold as (
  select track, island, i, start_ms, end_ms, text, cue_id, start_ms as begin_ms, 1 as g from shorts where i = 1
  union all
  select s.track, s.island, s.i, s.start_ms, s.end_ms, s.text, s.cue_id,
    case when s.end_ms - f.begin_ms <= 7000 then f.begin_ms else s.start_ms end,
    case when s.end_ms - f.begin_ms <= 7000 then f.g else f.g + 1 end
  from fold f join shorts s on s.track = f.track and s.island = f.island and s.i = f.i + 1),
merged as (
  select track, start_ms, end_ms, text, cue_id, 1 as n_merged from flagged where not short
  union all
  select track, min(start_ms), arg_max(end_ms, i), string_agg(text, ' ' order by i), arg_min(cue_id, i), count(*) from fold group by track, island, g)
"""


def timecode_sql(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', greatest({ms}, 0) // 3600000, greatest({ms}, 0) // 60000 % 60, greatest({ms}, 0) // 1000 % 60, greatest({ms}, 0) % 1000)"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, start_ms, end_ms: each user's cues, each ending at least a second before the next starts."""
    c = cues(spark, sf_dir).select(F.col("user_id").cast("string").alias("media_id"), "start_ms", "end_ms", "cue_id")
    from pyspark.sql import Window

    ahead = F.lead("start_ms").over(Window.partitionBy("media_id").orderBy("start_ms", "cue_id"))
    return c.withColumn("end_ms", F.least("end_ms", F.coalesce(ahead - 1000, F.col("end_ms")))).where("end_ms > start_ms").drop("cue_id")


MEDIA = f"""
{CUES},
media as (
  select * from (
    select cast(user_id as varchar) as media_id, start_ms,
      least(end_ms, coalesce(lead(start_ms) over (partition by user_id order by start_ms, cue_id) - 1000, end_ms)) as end_ms
    from cues)
  where end_ms > start_ms)
"""


def pieces(spark: SparkSession, sf_dir: str, sample_rate: int) -> DataFrame:
    """media_id, first_sample, sample_rate, pcm: every vector is a piece of audio, in eight media."""
    first = F.floor(F.col("vec_id") / 8) * 64
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 8).cast("string").alias("media_id"), first.alias("first_sample"), F.lit(sample_rate).alias("sample_rate"), F.col("embedding").alias("pcm"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of calls on one track per event_type, with user_id as position: some are invalid, some name no cue."""
    e = table(spark, sf_dir, "events")
    name = F.expr("case event_id % 4 when 0 then 'this_is_fine' when 3 then 'other' else 'this_should_be' end")
    return e.select(
        F.col("event_type").alias("track"), F.col("event_id").alias("call_seq"), name.alias("name"), F.col("user_id").alias("pos"),
        F.expr("'first ' || event_id").alias("first_text"), F.expr("case when event_id % 5 = 0 then '' else 'second ' || event_id end").alias("second_text"),
    )


CALLS = """
calls as (
  select event_type as track, event_id as call_seq, case event_id % 4 when 0 then 'this_is_fine' when 3 then 'other' else 'this_should_be' end as name,
    user_id as pos, 'first ' || event_id as first_text, case when event_id % 5 = 0 then '' else 'second ' || event_id end as second_text
  from events)
"""


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, pos (1 to the number of cues), text of two lines, state (every seventh and the first three finished already): a row per cue."""
    rows = number_cues(cues(spark, sf_dir), "pos")
    none = F.lit(None).cast("string")
    return rows.select("track", "pos", F.expr("track || '\\n' || pos").alias("text"), F.expr("case when pos % 7 = 0 or pos < 4 then 'finished' else 'unfinished' end").alias("state"), none.alias("first_text"), none.alias("second_text"))


STATE = """
state as (
  select track, pos, track || chr(10) || pos as text, case when pos % 7 = 0 or pos < 4 then 'finished' else 'unfinished' end as state
  from (select event_type as track, row_number() over (partition by event_type order by (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 100000, event_id) as pos from events))
"""
