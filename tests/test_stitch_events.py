import random
from datetime import datetime, timedelta, timezone

import pytest

from cuelake.operators import timeline
from cuelake.session import ROCKSDB
from cuelake.streaming.stitch_events import stitch_events

SCHEMA = "media_id string, began timestamp, chunk_no long, start_ms long, end_ms long, is_last boolean"
BEGAN = datetime(2024, 5, 1, tzinfo=timezone.utc)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    yield spark
    spark.conf.set(name, before)


def run(spark, tmp_path, batches, delay, restart_after=None):
    """The spans of batches that come one after the other; the query may be started again in between."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if k == restart_after or k == len(batches) - 1:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
            q = stitch_events(stream, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert q.awaitTermination(240)
    return sorted((r.media_id, r.frag_id, r.start_ms, r.end_ms, r.n_parts) for r in spark.read.schema("media_id string, frag_id long, start_ms long, end_ms long, n_parts long").parquet(out).collect())


def spans_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.media_id, r.frag_id, r.start_ms, r.end_ms, r.n_parts) for r in timeline.stitch(df).collect())


def speech(media, seed, until):
    """Segments as a detector gives them chunk by chunk, some up to the border."""
    r, at, out = random.Random(seed), 0, []
    while at < until:
        end = at + r.choice((400, 2_000, 29_000, 70_000))
        first, last = at // 30_000, (end - 1) // 30_000
        for c in range(first, last + 1):
            out.append((media, BEGAN, c, max(at, c * 30_000), min(end, (c + 1) * 30_000), False))
        at = end + r.choice((40, 300, 5_000, 28_000, 200_000))
    return out


FLUSH = [("zz", BEGAN + timedelta(days=1), 0, 0, 10, True)]


def test_shuffled_arrival_pauses_and_a_restart_give_the_spans_of_stitch(rocks, tmp_path):
    rows = speech("a", 1, 900_000) + speech("b", 2, 700_000)
    r = random.Random(3)
    # none comes later than 2 minutes after its time; pauses of 200 s lie between
    arrival = sorted(rows, key=lambda x: x[3] + r.randrange(0, 120_000))
    size = len(arrival) // 5 + 1
    batches = [arrival[i : i + size] for i in range(0, len(arrival), size)]
    got = run(rocks, tmp_path, [*batches, FLUSH], "3 minutes", restart_after=1)
    assert [x for x in got if x[0] != "zz"] == spans_of(rocks, rows)


def test_speech_after_a_pause_has_the_next_number_and_too_late_rows_have_none(rocks, tmp_path):
    first = [("m", BEGAN, 0, 29_000, 30_000, False), ("m", BEGAN, 0, 100, 500, False)]
    other = [("n", BEGAN, 20, 600_000, 600_100, False)]  # the stream's time goes on, so m's open span ends
    late = [("m", BEGAN, 1, 30_100, 31_000, False), ("m", BEGAN, None, 1, 2, False), (None, BEGAN, 1, 1, 2, False)]
    more = [("m", BEGAN, 30, 900_000, 901_000, False), ("m", BEGAN, 31, 940_000, 941_000, True)]
    # rows are late by the watermark of the batch before
    again = [("n", BEGAN, 21, 640_000, 640_100, False)]
    got = run(rocks, tmp_path, [first, other, again, late, more, FLUSH], "10 seconds")
    assert [x for x in got if x[0] == "m"] == [("m", 0, 100, 500, 1), ("m", 1, 29_000, 30_000, 1), ("m", 2, 900_000, 901_000, 1), ("m", 3, 940_000, 941_000, 1)]
    assert ("n", 0, 600_000, 600_100, 1) in got
