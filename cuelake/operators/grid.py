"""Speaker grids and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPEAKERS = range(200)


def speaker_grid(texts: DataFrame, first: int, last: int) -> DataFrame:
    """texts with speaker_id: every row once per speaker from first to last, which are checked."""
    if first not in SPEAKERS or last not in SPEAKERS or first > last:
        raise ValueError(f"speakers run from {SPEAKERS[0]} to {SPEAKERS[-1]}, and first must not pass last")
    return texts.withColumn("speaker_id", F.explode(F.sequence(F.lit(first), F.lit(last))))


def run_summary(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """total, succeeded, failed, success_percent, mean_ms of results (keys, ok, ms)."""
    n, ok = F.count("*"), F.count_if("ok")
    return results.groupBy(*keys).agg(n.alias("total"), ok.alias("succeeded"), (n - ok).alias("failed"), F.round(100.0 * ok / n, 1).alias("success_percent"), F.floor(F.avg("ms")).alias("mean_ms"))


def remaining_ms(done: Column, total: Column, elapsed_ms: Column) -> Column:
    """Time that the rest will take at the rate so far; null before anything is done."""
    return F.when(done > 0, F.floor(elapsed_ms * (total - done) / done))


def readable_size(n_bytes: Column) -> Column:
    """Bytes in KB below one MB, else in MB, with one decimal."""
    return F.when(n_bytes < 1 << 20, F.format_string("%.1f KB", n_bytes / 1024)).otherwise(F.format_string("%.1f MB", n_bytes / (1 << 20)))
