"""Refinement of cue texts in windows: state, calls, schedule, progress, and the loop with its checkpoints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_two_lines, join_pair, preview
from .call_log import CallLog

KEEP, CHANGE = "this_is_fine", "this_should_be"
VERSION = "1.0.0"


def new_state(cues: DataFrame) -> DataFrame:
    """cues (track, pos, text, ...) as state: 1-based pos, state unfinished, no refined texts."""
    none = F.lit(None).cast("string")
    return cues.withColumns({"state": F.lit("unfinished"), "first_text": none, "second_text": none})


def valid_calls(calls: DataFrame) -> DataFrame:
    """Calls that can be applied: a known name, a position that isn't null or 0, and for a change two non-empty texts."""
    change = (F.col("name") == CHANGE) & (F.coalesce("first_text", F.lit("")) != "") & (F.coalesce("second_text", F.lit("")) != "")
    return calls.where(F.col("pos").isNotNull() & (F.col("pos") != 0) & ((F.col("name") == KEEP) | change))


def apply_calls(state: DataFrame, calls: DataFrame) -> DataFrame:
    """state after all calls (track, call_seq, name, pos, first_text, second_text), as if applied in order of call_seq.

    Any valid call finishes its cue; the last change sets its texts, also of a finished cue: second (target) on top.
    """
    change = F.struct("first_text", "second_text")
    per = valid_calls(calls).groupBy("track", "pos").agg(F.max_by(F.when(F.col("name") == CHANGE, change), F.when(F.col("name") == CHANGE, F.col("call_seq"))).alias("_c"))
    s = state.join(per.select(F.col("track").alias("_t"), F.col("pos").alias("_p"), F.lit(True).alias("_hit"), "_c"), (F.col("track") == F.col("_t")) & (F.col("pos") == F.col("_p")), "left")
    changed = F.col("_c").isNotNull()
    return s.withColumns({
        "state": F.when(F.col("_hit"), F.lit("finished")).otherwise(F.col("state")),
        "text": F.when(changed, join_pair(F.col("_c.second_text"), F.col("_c.first_text"))).otherwise(F.col("text")),
        "first_text": F.when(changed, F.col("_c.first_text")).otherwise(F.col("first_text")),
        "second_text": F.when(changed, F.col("_c.second_text")).otherwise(F.col("second_text")),
    }).drop("_t", "_p", "_hit", "_c")


def progress(state: DataFrame) -> DataFrame:
    """track, total, finished, refined, first_unfinished (-1: none), refined_percent (one decimal)."""
    refined = F.count_if(F.col("first_text").isNotNull())
    return state.groupBy("track").agg(
        F.count("*").alias("total"), F.count_if(F.col("state") == "finished").alias("finished"), refined.alias("refined"),
        F.coalesce(F.min(F.when(F.col("state") == "unfinished", F.col("pos"))), F.lit(-1)).alias("first_unfinished"),
        F.round(100.0 * refined / F.count("*"), 1).alias("refined_percent"),
    )


def window_bounds(first_unfinished: Column, total: Column, size: int, preferred: Column | None = None) -> Column:
    """struct<win_start,win_end> around the first unfinished position; null if there is none.

    It starts half a window before that position, or at a preferred place not before it; at the end of the track
    it is moved back to keep its size.
    """
    least = first_unfinished - size // 2
    start = F.greatest(least if preferred is None else F.greatest(F.coalesce(preferred, least), least), F.lit(1))
    over = start + size - 1 > total
    return F.when(first_unfinished > 0, F.struct(F.when(over, F.greatest(total - size + 1, F.lit(1))).otherwise(start).alias("win_start"), F.least(start + size - 1, total).alias("win_end")))


def windows(state: DataFrame, size: int) -> DataFrame:
    """track, win_start, win_end, first_unfinished, context_count, unfinished_count of every track that isn't done.

    Context is what is finished in the window before the first unfinished position.
    """
    p = progress(state).where("first_unfinished > 0").select(F.col("track").alias("_t"), "first_unfinished", window_bounds(F.col("first_unfinished"), F.col("total"), size).alias("w"))
    rows = state.join(p, F.col("track") == F.col("_t")).where("pos between w.win_start and w.win_end")
    return rows.groupBy("track", "w.win_start", "w.win_end", "first_unfinished").agg(
        F.count_if((F.col("pos") < F.col("first_unfinished")) & (F.col("state") == "finished")).alias("context_count"), F.count_if(F.col("state") == "unfinished").alias("unfinished_count"),
    )


def schedule_round(pos: Column, size: int) -> Column:
    """The round in which a position is finished if every round finishes its whole window."""
    step = size - size // 2
    return F.when(pos <= size, F.lit(1).cast("bigint")).otherwise(F.floor((pos - size - 1) / step) + 2)


def window_text(rows: DataFrame) -> DataFrame:
    """track, win, prompt: the text of windows (rows: track, win, pos, text) for a language model."""
    lines = F.split("text", "\n", -1)
    no = F.concat(F.lit("Subtitle #"), F.col("pos").cast("string"), F.lit(":"))
    one = F.when(has_two_lines(F.col("text")), F.concat(no, F.lit("\n  Target: "), F.get(lines, F.lit(0)), F.lit("\n  Source: "), F.get(lines, F.lit(1)))).otherwise(F.concat(no, F.lit(" "), F.col("text")))
    per = rows.groupBy("track", "win").agg(F.sort_array(F.collect_list(F.struct("pos", F.concat(one, F.lit("\n")).alias("t")))).alias("e"))
    return per.select("track", "win", F.array_join(F.transform("e", lambda x: x["t"]), "\n").alias("prompt"))


def window_display(rows: DataFrame) -> DataFrame:
    """track, pos, line: a mark for the state, the position, a preview, and a mark on the first unfinished cue (is_center)."""
    mark = F.when(F.col("state") == "finished", F.lit("✓")).otherwise(F.lit("○"))
    line = F.concat(F.lit("  "), mark, F.lit(" ["), F.col("pos").cast("string"), F.lit("] "), preview(F.col("text")), F.when(F.col("is_center"), F.lit(" ← CENTER")).otherwise(F.lit("")))
    return rows.select("track", "pos", line.alias("line"))


@dataclass
class Config:
    window: int = 10
    max_idle: int = 3
    checkpoint_every: int = 5


@dataclass
class Stats:
    rounds: int = 0
    idle: int = 0
    calls: int = 0
    finished: list[int] = field(default_factory=list)


def refine(state: DataFrame, ask: Callable[[DataFrame, bool], DataFrame], save: Callable[[DataFrame, int], DataFrame], config: Config | None = None) -> tuple[DataFrame, Stats]:
    """Rounds of windows over all tracks at once until every cue is finished.

    ask(entries, retry) gets the entries of each unfinished track's window (with win_start, win_end) and returns
    calls. save(state, round) writes state where all executors reach it and returns it as read again, which ends
    its lineage; it is called every round, so a broken run resumes from its last state. Progress is a change in
    the number of finished cues. After max_idle rounds without any the run fails.
    """
    config, stats = config or Config(), Stats()
    state = save(state, 0)
    done, total = state.agg(F.count_if(F.col("state") == "finished"), F.count("*")).first()
    while done < total:
        stats.rounds += 1
        w = windows(state, config.window).select(F.col("track").alias("_t"), "win_start", "win_end", "first_unfinished")
        entries = state.join(w, F.col("track") == F.col("_t")).where("pos between win_start and win_end").drop("_t")
        stats.calls += 1
        state = save(apply_calls(state, ask(entries, stats.idle > 0)), stats.rounds)
        now = state.agg(F.count_if(F.col("state") == "finished")).first()[0]
        stats.idle = 0 if now > done else stats.idle + 1
        stats.finished.append(now)
        if stats.idle >= config.max_idle and now < total:
            raise RuntimeError(f"no progress in {stats.idle} rounds: {now} of {total} cues are finished")
        done = now
    return state, stats


def refine_logged(state: DataFrame | None, ask: Callable[[DataFrame, bool], DataFrame], log: CallLog, config: Config | None = None) -> tuple[DataFrame, Stats]:
    """As refine, but a round writes its calls only; the state is the log's base with the calls since.

    Every checkpoint_every rounds calls become part of the base. A log that was begun goes on where it stopped, whatever state
    is given; a round that a lost run left half-written is asked anew. Rounds are numbered on, so a later run's calls count after.
    """
    config, stats = config or Config(), Stats()
    if not log.begun():
        if state is None:
            raise ValueError("there is no log to resume, and no state to begin one")
        log.begin(state)
    now = log.state()
    done, total = now.agg(F.count_if(F.col("state") == "finished"), F.count("*")).first()
    while done < total:
        stats.rounds += 1
        w = windows(now, config.window).select(F.col("track").alias("_t"), "win_start", "win_end", "first_unfinished")
        entries = now.join(w, F.col("track") == F.col("_t")).where("pos between win_start and win_end").drop("_t")
        stats.calls += 1
        log.append(valid_calls(ask(entries, stats.idle > 0)))
        if stats.rounds % config.checkpoint_every == 0:
            log.compact()
        now = log.state()
        finished = now.agg(F.count_if(F.col("state") == "finished")).first()[0]
        stats.idle = 0 if finished > done else stats.idle + 1
        stats.finished.append(finished)
        if stats.idle >= config.max_idle and finished < total:
            raise RuntimeError(f"no progress in {stats.idle} rounds: {finished} of {total} cues are finished")
        done = finished
    return now, stats


def save_checkpoint(state: DataFrame, path: str, input_file: str, round_no: int) -> DataFrame:
    """Writes state under path/round=N with its version and input file, and returns it as read again."""
    where = f"{path.rstrip('/')}/round={round_no:08d}"
    state.withColumns({"_version": F.lit(VERSION), "_input": F.lit(input_file)}).write.mode("overwrite").parquet(where)
    return state.sparkSession.read.parquet(where).drop("_version", "_input")


def load_checkpoint(spark: SparkSession, path: str, input_file: str) -> DataFrame | None:
    """The state of the last round under path, or None if there is none of this version and input file."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    mine = rows.where((F.col("_version") == VERSION) & (F.col("_input") == input_file))
    last = mine.agg(F.max("round")).first()[0]
    return None if last is None else mine.where(F.col("round") == last).drop("round", "_version", "_input")


def delete_checkpoint(spark: SparkSession, path: str) -> bool:
    """Removes all rounds under path, as after a run that came to its end. Whether there was anything to remove."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
