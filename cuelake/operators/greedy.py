"""Greedy groups over one long order, in blocks of bounded size.

A group opens at some cue and takes the next ones until one ends more than max_ms after the group's start; that one opens
the next group. So all a block needs from before it is the start of the group that is open there, and what it does to
that start is a step function: it is found in one pass over the block, by jumps from each cue to the next opener. Functions
of neighbouring blocks are composed, FAN at a time, in as many rounds as the logarithm of their number; then the open group
before each block is handed down the same tree. No task holds more than a block of rows, or the functions of FAN blocks.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..session import saved
from . import ordered

#: Blocks, or nodes above them, that one task composes.
FAN = 64
#: Beyond any time in ms: the start of no group, and the limit of a function's last step.
NEVER = 1 << 62
#: In place of the opener's row: no group is open; the group that was open before still is.
CLOSED, SAME = -1, -2

Step = tuple[int, int, int]


def _tidy(steps: list[Step], low: int) -> list[Step]:
    """Steps (limit, begin, at) without those that repeat the one before or that no start up to low reaches."""
    out: list[Step] = []
    for limit, begin, at in steps:
        if out and out[-1][1:] == (begin, at):
            out.pop()
        out.append((limit, begin, at))
        if limit > low:
            break
    return [*out[:-1], (NEVER, *out[-1][1:])]


def _after(steps: list[Step], limits: list[int], begin: int, at: int) -> tuple[int, int]:
    """The open group after a block: the first step whose limit is above the start of the one before it."""
    step = steps[bisect_right(limits, begin)]
    return (begin, at) if step[2] == SAME else step[1:]


def _step_function(start: list[int], end: list[int], short: list[bool], new: list[bool], at: list[int], max_ms: int) -> list[Step]:
    n = len(start)
    reset = next((i for i in range(n - 1, -1, -1) if new[i] or not short[i]), None)
    if reset is not None:  # what comes after it doesn't depend on what came before
        begin, opener = -NEVER, CLOSED
        for i in range(reset if short[reset] else reset + 1, n):
            if end[i] - begin > max_ms:
                begin, opener = start[i], at[i]
        return [(NEVER, begin, opener)]
    jump, j = [n] * n, 0
    for i in range(n):
        j = max(j, i + 1)  # starts rise, so the next opener never lies before that of an earlier cue
        while j < n and end[j] - start[i] <= max_ms:
            j += 1
        jump[i] = j
    last = list(range(n))
    for i in range(n - 1, -1, -1):
        if jump[i] < n:
            last[i] = last[jump[i]]
    steps: list[Step] = []
    for i in range(n):
        limit = end[i] - max_ms
        if not steps or limit > steps[-1][0]:
            steps.append((limit, start[last[i]], at[last[i]]))
        if limit > start[0]:
            break
    else:
        steps.append((NEVER, -NEVER, SAME))
    return _tidy(steps, start[0])


def _compose(first: list[Step], second: list[Step], low: int) -> list[Step]:
    limits, out = [s[0] for s in second], []
    for limit, begin, at in first:
        if at == SAME:  # the last step
            out += [s for s in second if not out or s[0] > out[-1][0]]
        else:
            out.append((limit, *_after(second, limits, begin, at)))
    return _tidy(out, low)


def _same(a, b) -> bool:
    return (a is None and b is None) or a == b


def _nodes(pdf: pd.DataFrame, order: str) -> list[tuple]:
    """node, first and last track, low, steps."""
    pdf = pdf.sort_values(order)
    return [(n, f, la, lo, list(zip(*(x.tolist() for x in s)))) for n, f, la, lo, *s in pdf[[order, "first_track", "last_track", "low", "limits", "begins", "ats"]].itertuples(index=False)]


def _changes(track: pd.Series) -> list[bool]:
    """Whether a row is of another track than the one before it; the first isn't."""
    before = track.shift()
    out = ((track != before) & ~(track.isna() & before.isna())).tolist()
    return [False, *out[1:]]


def _with_entries(nodes: DataFrame) -> DataFrame:
    """node, begin, at: the group that is open before each node, by a tree over all nodes (numbered from 0)."""
    shape = StructType([StructField("node", LongType()), *[f for f in nodes.schema.fields if f.name != "node"]])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        children = _nodes(pdf, "node")
        number, first, last, low, steps = children[0]
        for _, f, la, _, s in children[1:]:
            steps = _compose(steps, s, low) if _same(last, f) else [(NEVER, *s[0][1:])]
            last = la
        return pd.DataFrame([(number // FAN, first, last, low, *map(list, zip(*steps)))], columns=shape.names)

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        begin, at, out, last = int(pdf["begin"].iloc[0]), int(pdf["at"].iloc[0]), [], None
        for k, (number, f, la, _, s) in enumerate(_nodes(pdf, "node")):
            if k and not _same(last, f):
                begin, at = -NEVER, CLOSED
            out.append((number, begin, at))
            begin, at = _after(s, [x[0] for x in s], begin, at)
            last = la
        return pd.DataFrame(out, columns=["node", "begin", "at"])

    parent = F.floor(F.col("node") / FAN)
    levels, n = [nodes.select(*shape.names)], nodes.count()
    while n > FAN:
        levels.append(saved(levels[-1].groupBy(parent).applyInPandas(compose, shape), "nodes"))
        n = -(-n // FAN)
    above = None
    for level in reversed(levels):
        if above is None:
            given = level.withColumns({"begin": F.lit(-NEVER), "at": F.lit(CLOSED).cast("bigint")})
        else:
            given = level.join(above.withColumnRenamed("node", "_up"), parent == F.col("_up")).drop("_up")
        above = saved(given.groupBy(parent).applyInPandas(hand_down, "node long, begin long, at long"), "entries")
    return above


def greedy_groups(rows: DataFrame, max_ms: int) -> DataFrame:
    """The short ones of rows with _group, the _at of the cue that opened their group.

    rows: as from ordered.ranged (_at, _block) by track and start_ms, with end_ms and _short. Rows that aren't short end groups
    and belong to none; tracks are apart.
    """
    track = rows.schema["track"].dataType
    numbers = ArrayType(LongType())
    shape = StructType([StructField("_block", LongType()), StructField("first_track", track), StructField("last_track", track), StructField("low", LongType()), *[StructField(n, numbers) for n in ("limits", "begins", "ats")]])

    def function(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        tracks = pdf["track"].astype(object).where(pdf["track"].notna(), None)
        steps = _step_function(*(pdf[c].tolist() for c in ("start_ms", "end_ms", "_short")), _changes(tracks), pdf["_at"].tolist(), max_ms)
        return pd.DataFrame([(pdf["_block"].iloc[0], tracks.iloc[0], tracks.iloc[-1], pdf["start_ms"].iloc[0], *map(list, zip(*steps)))], columns=shape.names)

    blocks = saved(rows.select("_block", "_at", "track", "start_ms", "end_ms", "_short").groupBy("_block").applyInPandas(function, shape), "blocks")
    # a range's blocks are numbered from 0 in its low bits; there are as many ranges as shuffle partitions
    bits = ordered.RANGE_BITS - ordered.BLOCK_BITS
    range_ = F.shiftright("_block", bits)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy(range_.alias("_range")).agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    nodes = saved(blocks.join(sizes, range_ == F.col("_range")).withColumn("node", F.col("_offset") + F.col("_block").bitwiseAND((1 << bits) - 1)).drop("_range", "_offset"), "nodes")
    entries = _with_entries(nodes.drop("_block")).join(nodes.select("node", F.col("_block").alias("_b")), "node").select("_b", F.col("begin").alias("_begin"), F.col("at").alias("_opener"))
    out = StructType([*[f for f in rows.schema.fields if f.name not in ("_short", "_block")], StructField("_group", LongType())])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        begin, opener, group = int(pdf["_begin"].iloc[0]), int(pdf["_opener"].iloc[0]), []
        for s, e, short, new, at in zip(*(pdf[c].tolist() for c in ("start_ms", "end_ms", "_short")), _changes(pdf["track"]), pdf["_at"].tolist()):
            if new or not short:
                begin, opener = -NEVER, CLOSED
            if short and e - begin > max_ms:
                begin, opener = s, at
            group.append(opener)
        return pdf.assign(_group=group)[pdf["_short"]][out.names]

    texts = rows.withColumn("text", F.when(F.col("_short"), F.col("text")))
    return texts.join(entries, F.col("_block") == F.col("_b")).drop("_b").groupBy("_block").applyInPandas(assign, out)
