"""Stitching of a stream of segments: the batch operator's rule, with one open span per medium as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.timeline import CHUNK_MS, EDGE_MS, GAP_MS

OUT = "media_id string, frag_id bigint, start_ms bigint, end_ms bigint, n_parts bigint"
STATE = "frag_id bigint, start_ms bigint, end_ms bigint, chunk_no bigint, n_parts bigint"


COLUMNS = ["media_id", "frag_id", "start_ms", "end_ms", "n_parts"]


def goes_on(end: int, last_chunk: int, chunk: int, start: int, chunk_ms: int, edge_ms: int, gap_ms: int) -> bool:
    """Whether a segment continues the span that ends at end in last_chunk."""
    low = chunk * chunk_ms
    return last_chunk + 1 == chunk and abs(end - low) < edge_ms and start - low < gap_ms


def stepper(chunk_ms: int, edge_ms: int, gap_ms: int, idle_ms: int | None):
    """What a batch, or a timeout, does to a medium's state: its last number and span, with n_parts 0 where no span is open."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now = list(state.get) if state.exists else None
        if state.hasTimedOut:
            if now and now[4]:
                out.append((key[0], now[0], now[1], now[2], now[4]))
                state.update((*now[:4], 0))  # numbers go on where speech does
            yield pd.DataFrame(out, columns=COLUMNS)
            return
        rows = pd.concat(list(batches)).sort_values(["start_ms", "end_ms"], kind="stable")
        ended = False
        for chunk, a, b, last in rows[["chunk_no", "start_ms", "end_ms", "is_last"]].itertuples(index=False):
            if now and now[4] and goes_on(now[2], now[3], chunk, a, chunk_ms, edge_ms, gap_ms):
                now[2], now[3], now[4] = max(now[2], b), chunk, now[4] + 1
            else:
                if now and now[4]:
                    out.append((key[0], now[0], now[1], now[2], now[4]))
                now = [now[0] + 1 if now else 0, a, b, chunk, 1]
            ended = ended or bool(last)
        if ended:
            if now and now[4]:
                out.append((key[0], now[0], now[1], now[2], now[4]))
            if state.exists:
                state.remove()
        elif now:
            state.update(tuple(int(x) for x in now))
            if idle_ms is not None and now[4]:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    return step


def stitch_stream(segments: DataFrame, chunk_ms: int = CHUNK_MS, edge_ms: int = EDGE_MS, gap_ms: int = GAP_MS, idle_ms: int | None = None) -> DataFrame:
    """Spans of a stream (media_id, chunk_no, start_ms, end_ms, is_last), whose segments come in order per medium.

    A span comes out when the next segment doesn't continue it, when its medium's last segment (is_last) has come,
    or, if idle_ms is given, when none of its segments has come for so long. Speech after such a pause is a span of its own
    with the next number. A query with idle_ms never runs out of batches, so it can't be drained with availableNow.
    Numbers and joins are as in stitch, but for spans that a pause ended.
    """
    step = stepper(chunk_ms, edge_ms, gap_ms, idle_ms)
    return segments.groupBy("media_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
