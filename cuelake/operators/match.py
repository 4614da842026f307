"""Matching cues to fragments by nearest start."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import bilingual_pair

TOLERANCE_MS = 500
#: Time in which cues and fragments meet in one group, and cues times starts that it holds at once.
STRETCH_MS, PAIRS = 1 << 18, 1 << 20
#: Beyond any time in ms.
NEVER = 1 << 62


def usable_cues(cues: DataFrame) -> DataFrame:
    """cues with target_text and source_text, without those where either is empty."""
    pair = bilingual_pair(F.col("text"))
    return cues.withColumns({"target_text": pair["target"], "source_text": pair["source"]}).where("target_text <> '' and source_text <> ''")


def existing(fragments: DataFrame, files: DataFrame) -> DataFrame:
    """Fragments whose file is listed (column file)."""
    return fragments.join(files.select("file").distinct(), "file", "left_semi")


def _nearest(cues: pa.Table, frags: pa.Table, tolerance_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cue the row of its fragment in frags, -1 for none, and the difference, -1 for unknown.

    A cue meets each start within the tolerance once, however many fragments have it, and looks up the ends on both sides of
    its own there. Where that gives nothing, as ends are unknown, the first fragment within the tolerance stands.
    """
    order = pc.sort_indices(frags, [("frag_start_ms", "ascending"), ("frag_end_ms", "ascending")]).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[pc.sort_indices(frags, [(c, "ascending") for c in ("frag_id", "frag_start_ms", "frag_end_ms")]).to_numpy()] = np.arange(len(order))
    rank, by_rank = rank[order], np.empty(len(order), np.int64)
    by_rank[rank] = order
    number = lambda t, c: pc.fill_null(t[c], NEVER).to_numpy()  # noqa: E731  what is unknown comes last
    fs, fe, s, e = number(frags, "frag_start_ms")[order], number(frags, "frag_end_ms")[order], number(cues, "start_ms"), number(cues, "end_ms")
    starts, first, of = np.unique(fs, return_index=True, return_inverse=True)
    last = np.append(first[1:], len(fs))
    ends = np.unique(fe)
    place = of * (len(ends) + 1) + np.searchsorted(ends, fe)
    low, high = np.searchsorted(starts, s - tolerance_ms), np.searchsorted(starts, s + tolerance_ms, "right")
    smallest = np.minimum.reduceat(rank, first)
    found, diff = np.full(len(s), -1), np.full(len(s), -1)
    some = np.flatnonzero(high > low)
    meets = (high - low)[some].cumsum()
    for part in np.split(some, np.searchsorted(meets, np.arange(PAIRS, meets[-1], PAIRS))) if len(some) else []:
        if not len(part):
            continue
        n = (high - low)[part]
        at, i = n.cumsum() - n, np.repeat(part, n)
        k = np.arange(n.sum()) - np.repeat(at - low[part], n)
        above = np.searchsorted(place, k * (len(ends) + 1) + np.searchsorted(ends, e[i]))
        d, r = np.full((2, len(k)), NEVER), np.full((2, len(k)), NEVER)
        for side, f in enumerate((above - 1, above)):
            ok = (f >= first[k]) & (f < last[k])
            f, c, ok = f[ok], i[ok], np.flatnonzero(ok)
            known = (fe[f] < NEVER) & (e[c] < NEVER)
            f, c, ok = f[known], c[known], ok[known]
            d[side, ok], r[side, ok] = np.abs(s[c] - fs[f]) + np.abs(e[c] - fe[f]), rank[f]
        best = np.minimum.reduceat(d.min(0), at)
        r = np.minimum.reduceat(np.where(d == np.repeat(best, n), r, NEVER).min(0), at)
        unknown = best == NEVER
        found[part] = by_rank[np.where(unknown, np.minimum.reduceat(smallest[k], at), r)]
        diff[part] = np.where(unknown, -1, best)
    return found, diff


def match_fragments(cues: DataFrame, fragments: DataFrame, keys: tuple[str, ...] = (), tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """cue_id and keys with the fragment that suits best: frag_id, frag_start_ms, frag_end_ms, diff_ms.

    A fragment fits if its start is within the tolerance; of those that fit, the least sum of start and end
    differences wins (an unknown one comes last), then the smallest frag_id. A fragment may serve several cues. Cues alike in
    start and end are matched once, and of such fragments only the first counts; they meet in stretches of time, a fragment
    standing in each that it is near. No row is made per pair.
    """
    wide, times = max(tolerance_ms, STRETCH_MS), ["start_ms", "end_ms"]
    given = lambda df: df.where(" and ".join(f"{c} is not null" for c in (*keys, "start_ms")))
    stretch = lambda x: F.floor((F.col("start_ms") + x) / wide)
    cues = given(cues.select(*keys, "cue_id", *(F.col(c).cast("bigint").alias(c) for c in times)))
    left = cues.select(*keys, *times).distinct().withColumn("_stretch", stretch(0))
    right = given(fragments.select(*keys, "frag_id", *(F.col(c).cast("bigint").alias(c) for c in times))).groupBy(*keys, *times).agg(F.min("frag_id").alias("frag_id"))
    right = right.select(*keys, "frag_id", F.col("start_ms").alias("frag_start_ms"), F.col("end_ms").alias("frag_end_ms"), F.explode(F.sequence(stretch(-tolerance_ms), stretch(tolerance_ms))).alias("_stretch"))
    kinds = {f.name: f for f in (*left.schema, *right.schema)}
    schema = StructType([kinds[c] for c in (*keys, *times, "frag_id", "frag_start_ms", "frag_end_ms")] + [StructField("diff_ms", LongType())])

    def run(some: pa.Table, near: pa.Table) -> pa.Table:
        found, diff = _nearest(some, near, tolerance_ms) if len(near) else (np.full(len(some), -1),) * 2
        hit = found >= 0
        some, near, diff = some.filter(hit).select([*keys, *times]), near.take(found[hit]).select(["frag_id", "frag_start_ms", "frag_end_ms"]), diff[hit]
        for c in near.column_names:
            some = some.append_column(c, near[c])
        return some.append_column("diff_ms", pa.array(diff, mask=diff < 0))

    by = [*keys, "_stretch"]
    matched = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema).withColumnsRenamed({c: f"_{c}" for c in (*keys, *times)})
    on = [F.col(c) == F.col(f"_{c}") for c in (*keys, "start_ms")] + [F.col("end_ms").eqNullSafe(F.col("_end_ms"))]
    near = cues.join(matched, on)
    best = near.groupBy(*keys, "cue_id").agg(F.min(F.struct(F.col("diff_ms").isNull().alias("unknown"), "diff_ms", "frag_id", "frag_start_ms", "frag_end_ms")).alias("b"))
    return best.select(*keys, "cue_id", "b.frag_id", "b.frag_start_ms", "b.frag_end_ms", "b.diff_ms")


def unmatched(cues: DataFrame, matches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The cues that no match names."""
    return cues.join(matches.select(*keys, "cue_id"), [*keys, "cue_id"], "left_anti")
