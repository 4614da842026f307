"""Operators on cues: merging short ones, numbering, validation, bilingual detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_two_lines
from .greedy import greedy_groups
from .ordered import numbered, ranged, with_next

MIN_MS, MAX_MS = 500, 7000
#: Cues of a track are handled in stretches of so much time, which bounds the rows of a task by cue density.
BLOCK_MS = 6 * 3600 * 1000


def _block() -> Column:
    return F.floor(F.col("start_ms") / BLOCK_MS)


def merge_short(cues: DataFrame, min_ms: int = MIN_MS, max_ms: int = MAX_MS, by_line: bool = False) -> DataFrame:
    """track, start_ms, end_ms, text, cue_id, n_merged: runs of cues shorter than min_ms merged greedily.

    In order of (start_ms, cue_id, end_ms, text), a short cue opens a group, and further short ones join it while the group
    stays within max_ms; a cue that isn't short ends it and is never merged. Texts join by a space, or line by
    line if by_line and all have as many lines. The group's end is its last cue's. Cues without a start or an end are left out,
    a null text is empty, a null track is a track. Cues are folded in blocks of bounded size, however long a run of
    short ones is and however dense (greedy_groups); only a group, whose cues start within max_ms, is gathered in a row.
    """
    short = (F.col("end_ms") - F.col("start_ms")) < min_ms
    rows = cues.select("track", "cue_id", "start_ms", "end_ms", "text").withColumn("_short", short).where("_short is not null")
    rows = ranged(rows, ["track"], ["start_ms", "cue_id", "end_ms"], ["text"], "cues")
    whole = rows.where(~F.col("_short")).select("track", "start_ms", "end_ms", "text", "cue_id", F.lit(1).cast("bigint").alias("n_merged"))
    item = F.struct("_at", "start_ms", "cue_id", "end_ms", "text")
    per = greedy_groups(rows, max_ms).groupBy("_group").agg(F.first("track").alias("track"), F.sort_array(F.collect_list(item)).alias("c"))
    texts = F.transform("c", lambda x: F.coalesce(x["text"], F.lit("")))
    text = F.array_join(texts, " ")
    if by_line:
        lines = F.transform(texts, lambda t: F.split(t, "\n", -1))
        n = F.size(F.get(lines, F.lit(0)))
        even = F.forall(lines, lambda x: F.size(x) == n)
        text = F.when(even, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.transform(lines, lambda x: F.get(x, i)), " ")), "\n")).otherwise(text)
    first, last = F.get("c", F.lit(0)), F.element_at("c", -1)
    merged = per.select("track", first["start_ms"].alias("start_ms"), last["end_ms"].alias("end_ms"), text.alias("text"), first["cue_id"].alias("cue_id"), F.size("c").cast("bigint").alias("n_merged"))
    return whole.unionByName(merged)


def number_cues(cues: DataFrame, out: str = "number") -> DataFrame:
    """1-based numbers by (start_ms, cue_id) within a track."""
    return numbered(cues, ["track"], ["start_ms", "cue_id"], _block(), out)


ISSUES = ("missing_start", "missing_end", "missing_text", "negative_start", "negative_end", "end_not_after_start", "overlap")


def timing_issues(cues: DataFrame, per_block: int = 100_000) -> DataFrame:
    """track, position (0-based, in order of ord), issue: one row per fault, a cue may have several.

    A cue overlaps if the next one in list order starts before it ends. Missing values make no other issue.
    """
    rows = cues.select("track", "ord", "start_ms", "end_ms", "text")
    block = F.floor(F.col("ord") / per_block)
    rows = with_next(rows, ["track"], ["ord"], block, "start_ms", "_next")
    rows = numbered(rows, ["track"], ["ord"], F.floor(F.col("ord") / per_block), "_no")
    s, e = F.col("start_ms"), F.col("end_ms")
    checks = (s.isNull(), e.isNull(), F.col("text").isNull(), s < 0, e < 0, e <= s, F.col("_next") < e)
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in zip(checks, ISSUES)]), lambda x: x.isNotNull())
    return rows.select("track", (F.col("_no") - 1).alias("position"), F.explode(found).alias("issue"))


def bilingual_share(cues: DataFrame, first: int = 5, share: float = 0.8) -> DataFrame:
    """track, n, n_two_lines, is_bilingual, judged by the first few cues in order of ord."""
    # the first rows of each task meet first: no task gets more than they leave of a track
    w = Window.partitionBy("track").orderBy("ord")
    head = cues.select("track", "ord", has_two_lines(F.col("text")).alias("two")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first)
    n, two = F.count("*"), F.count_if("two")
    return head.groupBy("track").agg(n.alias("n"), two.alias("n_two_lines")).withColumn("is_bilingual", F.col("n_two_lines") * 1.0 >= F.col("n") * share)
