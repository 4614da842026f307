"""Resampling of audio in pieces, by a polyphase filter whose reach takes in samples of the neighbours.

Output is dealt into blocks. A piece sends each block the samples that the block's filter reaches, so a block has all it needs
in one group, whatever the cut into pieces, and an output sample is the same sum in every cut.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of an output block; zero crossings of the filter on each side; shape of its window.
BLOCK, ZEROS, BETA = 1 << 16, 16, 8.0


@lru_cache(maxsize=16)
def filter_bank(source: int, target: int) -> np.ndarray:
    """A row of taps per phase: a windowed sinc at the lower of the two band limits, of gain one."""
    g = gcd(source, target)
    up, down = target // g, source // g
    cutoff = min(1.0, target / source)
    half = reach(source, target)
    t = np.arange(-half + 1, half + 1)[None, :] - (np.arange(up) / up)[:, None]
    window = np.i0(BETA * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(BETA)
    taps = np.sinc(cutoff * t) * window
    return taps / taps.sum(1, keepdims=True)


def reach(source: int, target: int) -> int:
    """Source samples that an output sample takes in on each side."""
    return int(np.ceil(ZEROS * max(1.0, source / target)))


def resampled_block(x: np.ndarray, first: int, covered: np.ndarray, low: int, high: int, source: int, target: int) -> tuple[int, np.ndarray]:
    """Output samples of [low, high) for source samples x from `first` on; samples that are not there count as zero.

    An output sample is made if its own time, and the source sample that ends it, are covered; so n samples give
    n * target // source.
    """
    g = gcd(source, target)
    up, down = target // g, source // g
    bank, half = filter_bank(source, target), reach(source, target)
    m = np.arange(low, high, dtype=np.int64)
    at, last = m * down // up - first, -(-(m + 1) * down // up) - 1 - first
    there = lambda k: (k >= 0) & (k < len(x)) & covered[np.clip(k, 0, len(x) - 1)]
    made = there(at) & there(last)
    m, at = m[made], at[made]
    padded = np.concatenate([np.zeros(half, np.float64), x.astype(np.float64), np.zeros(half + 1, np.float64)])
    out = np.empty(len(m), np.float32)
    for k in range(0, len(m), 8192):
        part = at[k : k + 8192]
        out[k : k + 8192] = np.einsum("ij,ij->i", padded[part[:, None] + np.arange(1, 2 * half + 1)], bank[m[k : k + 8192] % up])
    return (int(m[0]) if len(m) else low), out


def resample(pieces: DataFrame, target: int, block: int = BLOCK) -> DataFrame:
    """media_id, first_sample, sample_rate, pcm: pieces (of these columns) at another rate, as blocks in order of first_sample.

    A medium of n samples gets n * target // rate. A medium's pieces have one rate each; media may differ. What no
    piece covers stays a hole, which sounds as silence to its neighbours. Empty and null pieces have no samples, and pieces
    at the target rate are returned as they are.
    """
    rows = pieces.where(F.size("pcm") > 0).select("media_id", "first_sample", "sample_rate", "pcm")
    if target <= 0:
        raise ValueError("a sample rate is above zero")
    other = rows.where(F.col("sample_rate") != target)
    rate, at = F.col("sample_rate").cast("bigint"), F.col("first_sample")
    half = F.ceil(ZEROS * F.greatest(F.lit(1.0), rate / target)).cast("bigint")
    # a block [j * block, (j + 1) * block) reaches from its first sample's time less half a filter to its last's and half a filter
    first = F.floor(F.greatest(at - half - 1, F.lit(0)) * target / rate / block)
    last = F.floor((at + F.size("pcm") + half) * target / rate / block)

    def part(no):
        low = F.greatest(F.floor(no * block * rate / target) - half - at, F.lit(0)).cast("int")
        high = F.least(F.ceil((no + 1) * block * rate / target) + half + 1 - at, F.size("pcm")).cast("int")
        return F.struct(no.alias("no"), (at + low).alias("place"), F.slice("pcm", low + 1, F.greatest(high - low, F.lit(0))).alias("part"))

    parts = other.select("media_id", "sample_rate", F.explode(F.transform(F.sequence(first, last), part)).alias("p")).select("media_id", "sample_rate", "p.*").where(F.size("part") > 0)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        media, source, no = key
        start = int(pdf["place"].min())
        x = np.zeros(int((pdf["place"] + pdf["part"].map(len)).max()) - start, np.float32)
        covered = np.zeros(len(x), bool)
        for place, part in zip(pdf["place"], pdf["part"]):
            x[place - start : place - start + len(part)] = part
            covered[place - start : place - start + len(part)] = True
        low, out = resampled_block(x, start, covered, int(no) * block, (int(no) + 1) * block, int(source), target)
        return pd.DataFrame([(media, low, target, out)] if len(out) else [], columns=["media_id", "first_sample", "sample_rate", "pcm"], dtype=object)

    done = parts.groupBy("media_id", "sample_rate", "no").applyInPandas(run, "media_id string, first_sample bigint, sample_rate int, pcm array<float>")
    same = rows.where(F.col("sample_rate") == target).select(F.col("media_id").cast("string"), F.col("first_sample").cast("bigint"), F.col("sample_rate").cast("int"), F.col("pcm").cast("array<float>"))
    return done.unionByName(same)
