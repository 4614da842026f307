import datetime as dt
import textwrap

from cuelake.plans import catalogue

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def code(ms):
    return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def test_entries_of_wrapped_texts_are_returned(spark, tmp_path):
    """Twelve short cues merge into a text of over 80 characters; a normal cue follows."""
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=100 * ms)
    rows = [(1000 + k, at(100 * k), 1, "purchase", 5.0, "{}") for k in range(12)] + [(2000, at(9000), 1, "purchase", 100.0, "{}")]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    long = textwrap.fill(" ".join(f"purchase:{1000 + k}" for k in range(12)), 80)
    assert long.count("\n") == 2
    want = {(1, f"1\n{code(0)} --> {code(1150)}\n{long}\n"), (2, f"2\n{code(9000)} --> {code(10000)}\npurchase:2000\n")}
    assert {(x.number, x.entry) for x in catalogue.queries()["srt_entries"](spark, str(tmp_path)).collect()} == want
