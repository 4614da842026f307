import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import audio, overlay

SPANS = "media_id string, ord long, first long, last long, value long"


def brute(rows):
    """Maximal runs by painting every sample."""
    out = []
    for m in {r[0] for r in rows}:
        paint = {}
        for _, o, a, b, v in sorted((r for r in rows if r[0] == m), key=lambda r: (r[1], r[2])):
            paint |= dict.fromkeys(range(a, b + 1), (o, a, v))
        for k in sorted(paint):
            if out and out[-1][0] == m and out[-1][2] + 1 == k and out[-1][3] == paint[k]:
                out[-1][2] = k
            else:
                out.append([m, k, k, paint[k]])
    return sorted(((m, a, b, p[2]) for m, a, b, p in out), key=repr)


def got(spark, rows):
    return sorted((tuple(r) for r in overlay.overlay_runs(spark.createDataFrame(rows, SPANS)).select("media_id", "first", "last", "value").collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_runs_are_what_painting_gives(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(300):
        m, a = r.choice(["hot"] * 6 + ["b", "c", None]), r.randint(-50, 900)
        rows.append((m, k, a, a + r.choice([-1, 0, 3, 20, 20, 400, 1000]), k % 5))
    r.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_runs_over_many_ranges_are_joined(spark):
    rows = [("m", 10_000, 0, 5000, 1)] + [("m", k, 10 * k, 10 * k + 30, 2) for k in range(1000)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert got(spark, rows)[0] == ("m", 0, 5000, 1) and got(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repeats_ties_and_nothing(spark):
    assert got(spark, []) == []
    rows = [("m", 1, 0, 9, 1), ("m", 1, 0, 9, 1), ("m", 1, 5, 12, 2), ("m", 0, 0, 20, 3), ("m", 7, 4, 3, 9)]
    assert got(spark, rows) == brute([r for r in rows if r[3] >= r[2]])


def test_equals_the_exploded_form(spark):
    r = random.Random(5)
    rows = [("m", k, a := r.randint(0, 500), a + r.randint(0, 40), k) for k in range(200)]
    df = spark.createDataFrame(rows, SPANS)
    runs = overlay.overlay_runs(df).select("media_id", "value", F.explode(F.sequence("first", "last")).alias("sample"))
    key = lambda d: sorted((x.media_id, x.sample, x.value) for x in d.collect())
    assert key(runs) == key(audio.overlay_samples(df))
