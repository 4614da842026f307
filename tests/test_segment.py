import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake import session
from cuelake.functions import text
from cuelake.operators import grid, refine, segment, tools
from cuelake.operators.providers import EnergyVad
from cuelake.sources import wav

PIECES = "media_id string, first_sample long, sample_rate int, pcm array<float>"
SPANS = "media_id string, frag_id long, start_ms long, end_ms long"


def pieces(spark, media, rate, size):
    return spark.createDataFrame([(m, int(a), rate, x[a : a + size].tolist()) for m, x in media.items() for a in range(0, len(x), size)] + [("none", 0, rate, None), ("none", 0, rate, [])], PIECES)


@pytest.mark.parametrize(("size", "chunk"), [(700, 1000), (5000, 30), (333, 20_000)])
def test_chunks_and_fragments_are_slices(spark, size, chunk):
    r = np.random.default_rng(size)
    media = {"a/b": r.random(3000).astype(np.float32), "c": r.random(101).astype(np.float32)}
    df = pieces(spark, media, 1000, size)
    got = {(x.media_id, x.chunk_no): x.pcm for x in segment.audio_chunks(df, chunk).collect()}
    assert got == {(m, k): x[k * chunk : (k + 1) * chunk].tolist() for m, x in media.items() for k in range(-(-len(x) // chunk))}
    spans = [("a/b", 0, 0, 10), ("a/b", 1, 995, 2100), ("a/b", 2, 2990, 9000), ("a/b", 3, 5000, 6000), ("c", 0, 50, 50), ("c", 1, -20, 30), ("d", 0, 0, 10), ("c", 2, 100, 101)]
    out = segment.cut_fragments(df, spark.createDataFrame(spans, SPANS), chunk)
    want = {(m, i): media[m][max(a, 0) : b].tolist() for m, i, a, b in spans if m in media and b > a and a < len(media[m])}
    assert {(x.media_id, x.frag_id): x.pcm for x in out.collect()} == want


def test_odd_chunks_are_an_error(spark):
    with pytest.raises(Exception, match="no whole number of samples"):
        segment.audio_chunks(spark.createDataFrame([("a", 0, 11025, [0.5] * 10)], PIECES), 33).collect()


def test_tones_to_files(spark, tmp_path):
    rate, x = 16_000, np.zeros(16_000 * 8, np.float32)
    speech = [(500, 1500), (2900, 4200), (6000, 7000)]  # the second crosses the border at 3 s
    for a, b in speech:
        x[a * 16 : b * 16] = 0.5 * np.sin(np.arange((b - a) * 16) * 0.2) + 0.2
    df = pieces(spark, {"m": x}, rate, 50_000)
    spans = segment.segment_audio(df, EnergyVad(min_speech_ms=50), chunk_ms=3000)
    got = sorted((r.start_ms, r.end_ms) for r in spans.collect())
    assert all(abs(a - c) <= 10 and abs(b - d) <= 10 for (a, b), (c, d) in zip(got, speech, strict=True))
    listing = segment.write_fragments(segment.cut_fragments(df, spans, 3000), str(tmp_path / "out")).collect()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(r.file for r in listing)
    for r in listing:
        raw = (tmp_path / "out" / r.file).read_bytes()
        back_rate, back = wav.decode_wav(raw)
        assert len(raw) == r.n_bytes and back_rate == rate
        assert np.abs(back[:, 0] - x[r.start_ms * 16 : r.end_ms * 16]).max() < 1e-4
    assert segment.segment_audio(spark.createDataFrame([], PIECES)).count() == 0


def test_a_detector_that_fails_is_an_error(spark):
    class Broken(EnergyVad):
        def call(self, requests):
            return [None] * len(requests)

    with pytest.raises(Exception, match="speech detector failed"):
        segment.segment_audio(spark.createDataFrame([("a", 0, 1000, [0.5] * 10)], PIECES), Broken()).collect()


def test_tools_prompts_and_answers(spark):
    names = [refine.KEEP, refine.CHANGE]
    assert [t["function"]["name"] for t in tools.tools()] == [t["name"] for t in tools.tools("schema")] == names
    assert tools.tools("schema")[1]["input_schema"]["required"] == [tools.ID, tools.FIRST, tools.SECOND]
    with pytest.raises(ValueError):
        tools.tools("other")
    assert "German" in tools.system_prompt("English", "German") and "target language" in tools.system_prompt()
    assert [m["role"] for m in tools.messages("s", "w")] == ["system", "user"] and tools.messages("s", "w", True)[-1]["content"] == tools.RETRY
    one, again = spark.range(1).select(tools.user_prompt(F.lit("w")), tools.user_prompt(F.lit("w"), True)).first()
    assert one == tools.messages("s", "w")[1]["content"] and again == f"{one}\n\n{tools.RETRY}"
    good = json.dumps([{"name": refine.KEEP, "arguments": {"id": 3}}, {"name": refine.CHANGE, "arguments": {"id": 4, tools.FIRST: "f", tools.SECOND: "s"}}, {"name": "x"}])
    rows = spark.createDataFrame([("t", 1, good), ("t", 2, "no json"), ("t", 3, None), ("t", 4, "[]"), ("t", 5, "[null]")], "track string, round long, answer string")
    calls = tools.calls_of(rows).orderBy("call_seq")
    assert [(c.name, c.pos, c.first_text, c.second_text) for c in calls.collect()] == [(refine.KEEP, 3, None, None), (refine.CHANGE, 4, "f", "s"), ("x", None, None, None)]
    assert refine.valid_calls(calls).count() == 2


def test_numbers_checkpoints_and_settings(spark, tmp_path, monkeypatch):
    got = spark.sql("select * from values (0L, 10L, 5L), (4L, 10L, 1000L) v(d, t, e)").select(grid.remaining_ms(F.col("d"), F.col("t"), F.col("e")).alias("x")).collect()
    assert [r.x for r in got] == [None, 1500]
    sizes = spark.sql("select * from values (512L), (3145728L) v(n)").select(grid.readable_size(F.col("n")).alias("x")).collect()
    assert [r.x for r in sizes] == ["0.5 KB", "3.0 MB"]
    assert [bytes(r.x) if r.x else r.x for r in spark.sql("select * from values ('aGk='), ('%'), (null) v(t)").select(text.base64_bytes(F.col("t")).alias("x")).collect()] == [b"hi", None, None]
    where = str(tmp_path / "state")
    refine.save_checkpoint(spark.range(3).toDF("pos"), where, "in.srt", 1)
    assert not session.is_file(spark, where) and session.is_file(spark, __file__) and not session.is_file(spark, "/no/such")
    assert refine.delete_checkpoint(spark, where) and not refine.delete_checkpoint(spark, where)
    assert refine.load_checkpoint(spark, where, "in.srt") is None
    monkeypatch.setenv("CUELAKE_WINDOW", "7")
    assert session.Config.of().window == 7 and session.Config.of(window=3).window == 3 and session.Config.of().retries == 3
