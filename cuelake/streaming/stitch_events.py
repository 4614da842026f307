"""Stitching of a live stream by event time: segments may come late and in any order, within a delay."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.timeline import CHUNK_MS, EDGE_MS, GAP_MS
from .stitch import COLUMNS, OUT, goes_on

BUFFER = "start_ms bigint, end_ms bigint, chunk_no bigint, is_last boolean, event_ms bigint"
#: n_parts is 0 where no span is open; zero_ms is when the recording began.
SPAN = "frag_id bigint, start_ms bigint, end_ms bigint, chunk_no bigint, n_parts bigint, zero_ms bigint"


class Stitcher(StatefulProcessor):
    """Of each medium: the segments that the watermark hasn't passed, the open span, and the last number given.

    The watermark is a promise that nothing before it comes any more. What it has passed is folded in order of time;
    an open span ends when the watermark passes the last moment at which a segment could continue it.
    """

    def __init__(self, chunk_ms: int, edge_ms: int, gap_ms: int):
        self.chunk_ms, self.edge_ms, self.gap_ms = chunk_ms, edge_ms, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", BUFFER)
        self.span = handle.getValueState("span", SPAN)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        got = [tuple(r) for pdf in rows for r in zip(*(pdf[c].tolist() for c in ("start_ms", "end_ms", "chunk_no", "is_last", "event_ms")))]
        yield self.advance(key, [*self.held(), *got], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advance(key, self.held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def held(self) -> list[tuple]:
        return [tuple(r) for r in self.buffer.get()] if self.buffer.exists() else []

    def advance(self, key: Any, rows: list[tuple], mark: int) -> pd.DataFrame:
        out, now, ended = [], list(self.span.get()) if self.span.exists() else None, False
        due = sorted(r for r in rows if r[4] <= mark)
        for start, end, chunk, last, event in due:
            if now and now[4] and goes_on(now[2], now[3], chunk, start, self.chunk_ms, self.edge_ms, self.gap_ms):
                now[2], now[3], now[4] = max(now[2], end), chunk, now[4] + 1
            else:
                out += self.ended(key, now)
                now = [now[0] + 1 if now else 0, start, end, chunk, 1, event - start]
            ended = bool(last)
        if now and now[4] and (ended or self.over_at(now) <= mark):
            out += self.ended(key, now)
            now[4] = 0
        later = sorted((r for r in rows if r[4] > mark), key=lambda r: r[4])
        wake = [later[0][4]] if later else []
        if now and now[4]:
            wake.append(self.over_at(now))
        if later:
            self.buffer.put(later)
        else:
            self.buffer.clear()
        if ended and not later:
            self.span.clear()
        elif now:
            self.span.update(tuple(int(x) for x in now))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if wake:
            self.handle.registerTimer(min(wake))
        return pd.DataFrame(out, columns=COLUMNS)

    def over_at(self, now: list) -> int:
        """The event time from which on no segment continues the span."""
        border = (now[3] + 1) * self.chunk_ms
        return now[5] + border + self.gap_ms if abs(now[2] - border) < self.edge_ms else -1

    def ended(self, key: Any, now: list | None) -> list[tuple]:
        return [(key[0], now[0], now[1], now[2], now[4])] if now and now[4] else []


def stitch_events(segments: DataFrame, delay: str = "1 minute", chunk_ms: int = CHUNK_MS, edge_ms: int = EDGE_MS, gap_ms: int = GAP_MS) -> DataFrame:
    """Spans, with numbers and joins as in stitch, of a stream (media_id, began, chunk_no, start_ms, end_ms, is_last).

    began is when the recording began, so a segment's event time is began plus its start. Segments may come in any order, if
    none comes when the latest event time of the stream is more than delay ahead of its own; such ones are dropped by the
    watermark of the batch before theirs. A span comes out as soon as nothing can continue it, after a pause too, and numbers go on where speech does.
    After the segment in which is_last is true a medium's state goes; without one, a number per medium stays. Rows without a
    medium, a chunk or times are left out. Needs the RocksDB state store, which cuelake.session sets.
    """
    when = F.unix_millis(F.col("began")) + F.col("start_ms")
    rows = segments.select("media_id", "chunk_no", "start_ms", "end_ms", F.coalesce("is_last", F.lit(False)).alias("is_last"), when.alias("event_ms")).dropna(subset=["media_id", "chunk_no", "end_ms", "event_ms"])
    rows = rows.withColumn("event_time", F.timestamp_millis("event_ms")).withWatermark("event_time", delay)
    return rows.groupBy("media_id").transformWithStateInPandas(Stitcher(chunk_ms, edge_ms, gap_ms), OUT, "append", "EventTime")
