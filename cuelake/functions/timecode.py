"""SRT timecodes and sample positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT = r"^([0-9]+):([0-9]+):([0-9]+),([0-9]+)"
_LEADING = r"^\s*([+-]?[0-9]+)"


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.expr("cast(null as bigint)") if text is None else F.regexp_extract(text, pattern, group).try_cast("bigint")


def parse_timecode(text: Column, dialect: str = "strict") -> Column:
    """Milliseconds of HH:MM:SS,mmm, or null. The part after the comma counts milliseconds: ",5" is 5 ms.

    strict: four numbers at the beginning; what follows is ignored. lenient: the first three parts between colons,
    each read up to its first character that is no digit.
    """
    if dialect == "strict":
        part = [_number(text, STRICT, k) for k in (1, 2, 3, 4)]
    else:
        colon = F.split(text, ":")
        seconds = F.split(F.get(colon, F.lit(2)), ",")
        part = [_number(x, _LEADING, 1) for x in (F.get(colon, F.lit(0)), F.get(colon, F.lit(1)), F.get(seconds, F.lit(0)), F.get(seconds, F.lit(1)))]
    return ((part[0] * 60 + part[1]) * 60 + part[2]) * 1000 + part[3]


def format_timecode(ms: Column, clamp: bool = True) -> Column:
    """HH:MM:SS,mmm; hours grow as needed. Times before zero count as zero, or keep a sign if clamp is off."""
    t = F.greatest(ms, F.lit(0)).cast("bigint") if clamp else F.abs(ms).cast("bigint")
    whole = lambda unit, size: F.floor(t / unit) % size if size else F.floor(t / unit)
    out = F.format_string("%02d:%02d:%02d,%03d", whole(3_600_000, 0), whole(60_000, 60), whole(1000, 60), t % 1000)
    return out if clamp else F.when(ms < 0, F.concat(F.lit("-"), out)).otherwise(out)


def format_seconds(seconds: Column) -> Column:
    """Like format_timecode for seconds as floating point, milliseconds cut off as binary fractions have them."""
    t = F.greatest(seconds, F.lit(0.0))
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(t / 3600), F.floor((t % 3600) / 60), F.floor(t % 60), ((t % 1) * 1000).cast("bigint"),
    )


def sample_index(ms: Column, sample_rate: Column, n_samples: Column | None = None) -> Column:
    """The sample that plays at a time: cut off to a whole one, and to the length if that is given."""
    at = F.floor(ms * sample_rate / 1000).cast("bigint")
    return at if n_samples is None else F.least(at, n_samples)


def touches_chunk_end(end_ms: Column, chunk_end_ms: Column, within_ms: int = 100) -> Column:
    """Whether a segment ends so near the end of its chunk that its speech may go on in the next."""
    return F.abs(end_ms - chunk_end_ms) < within_ms
