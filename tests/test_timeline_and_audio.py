import random

import json

import numpy as np
from pyspark.sql import functions as F

from cuelake.functions import languages
from cuelake.operators import audio, grid, match, providers, timeline
from cuelake.sources import documents, wav

import pytest


def spans_of(df):
    return [(r.start_ms, r.end_ms, r.n_parts) for r in df.orderBy("frag_id").collect()]


def test_stitching_inverts_cutting(spark):
    spans = [(0, 500), (29_000, 31_000), (59_950, 60_000), (65_000, 190_000), (200_000, 209_990)]
    df = spark.createDataFrame([("m", a, b) for a, b in spans], "media_id string, start_ms long, end_ms long")
    got = spans_of(timeline.stitch(timeline.cut_at_chunks(df)))
    assert [(a, b) for a, b, _ in got] == spans
    assert got[3][2] == 5  # speech longer than a chunk ends, too


def test_stitching_tolerances(spark):
    rows = [("m", 0, 20_000, 29_901), ("m", 1, 30_499, 31_000), ("m", 2, 60_000, 60_100), ("n", 0, 0, 29_900), ("n", 1, 30_000, 30_100)]
    df = spark.createDataFrame(rows, "media_id string, chunk_no long, start_ms long, end_ms long")
    out = timeline.stitch(df)
    assert spans_of(out.where("media_id = 'm'")) == [(20_000, 31_000, 2), (60_000, 60_100, 1)]
    assert len(spans_of(out.where("media_id = 'n'"))) == 2


def test_stitching_over_many_stretches(spark, monkeypatch):
    spans = [(k * 7_000, k * 7_000 + 6_400) for k in range(200)] + [(2_000_000, 2_400_000)]
    df = timeline.cut_at_chunks(spark.createDataFrame([("m", a, b) for a, b in spans], "media_id string, start_ms long, end_ms long"))
    want = spans_of(timeline.stitch(df))
    assert [(a, b) for a, b, _ in want] == spans
    monkeypatch.setattr(timeline, "STRETCH_MS", 20_000)
    assert spans_of(timeline.stitch(df)) == want


def test_stream_gives_the_same_spans(spark, tmp_path):
    from cuelake.streaming.stitch import stitch_stream

    spans = [(0, 500), (29_000, 31_000), (65_000, 130_000)]
    df = spark.createDataFrame([("m", a, b) for a, b in spans] + [("k", 5, 10)], "media_id string, start_ms long, end_ms long")
    cut = timeline.cut_at_chunks(df).withColumn("is_last", ((F.col("media_id") == "m") & (F.col("end_ms") == 130_000)) | (F.col("media_id") == "k"))
    first, rest = cut.where("chunk_no < 1"), cut.where("chunk_no >= 1")
    src = str(tmp_path / "in")
    first.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(cut.schema).parquet(src)

    def pump():
        q = stitch_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "spans")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    pump()
    rest.coalesce(1).write.mode("append").parquet(src)
    pump()
    got = sorted((r.media_id, r.frag_id, r.start_ms, r.end_ms) for r in spark.read.parquet(str(tmp_path / "spans")).collect())
    want = sorted((r.media_id, r.frag_id, r.start_ms, r.end_ms) for r in timeline.stitch(cut.drop("is_last")).collect())
    assert got == want


def test_match_ties_tolerance_and_reuse(spark):
    cues = spark.createDataFrame([(1, 1000, 2000), (2, 1500, 2500), (3, 9000, 9100), (4, -100, 0)], "cue_id long, start_ms long, end_ms long")
    frags = spark.createDataFrame([(7, 1500, 2000), (5, 500, 2000), (9, 1501, 2500), (8, -600, 0)], "frag_id long, start_ms long, end_ms long")
    got = {r.cue_id: (r.frag_id, r.diff_ms) for r in match.match_fragments(cues, frags).collect()}
    assert got == {1: (5, 500), 2: (9, 1), 4: (8, 500)}
    assert [r.cue_id for r in match.unmatched(cues, match.match_fragments(cues, frags)).collect()] == [3]
    plan = match.match_fragments(cues, frags)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_match_equals_all_pairs_without_a_row_per_pair(spark, monkeypatch):
    """Dense times, many copies, unknown ends, fragments beside a stretch's border; the plan joins copies once and expands no pairs."""
    r = random.Random(4)
    time = lambda lo, n: r.choice([lo, lo + 1, lo + r.randrange(n)])
    rows = lambda n: [(r.choice("ab"), k, (s := time(r.choice([-3000, 0, 998, 20_000]), 2500)), None if r.random() < 0.05 else s + time(0, 900)) for k in range(n)]
    c, f = rows(700), [*rows(500), ("c", 900, 5, 6)]
    c += [("d", 900, 5, 6), (None, 901, 5, 6), ("a", 902, 30_000, 30_100), ("a", 903, 40_000, 40_100), ("a", 3, 30_001, None)]
    f += [(None, 901, 5, 6), ("a", 902, 30_000, None), ("a", 903, 30_001, None), ("a", 904, 40_300, None), ("a", 905, 40_400, 40_400)]
    want: dict = {}
    for key, cue, s, e in c:
        for k, frag, fs, fe in f:
            if key is not None and key == k and abs(s - fs) <= 500:
                d = None if e is None or fe is None else abs(s - fs) + abs(e - fe)
                want[key, cue] = min(want.get((key, cue), ((2,),)), ((d is None, d or 0, frag), (frag, fs, fe, d)))
    cues = spark.createDataFrame(c, "track string, cue_id long, start_ms long, end_ms long")
    frags = spark.createDataFrame(f, "track string, frag_id long, start_ms long, end_ms long")
    for stretch, pairs in ((match.STRETCH_MS, match.PAIRS), (1000, 7)):
        monkeypatch.setattr(match, "STRETCH_MS", stretch)
        monkeypatch.setattr(match, "PAIRS", pairs)
        got = match.match_fragments(cues, frags, ("track",))
        assert {(x.track, x.cue_id): (x.frag_id, x.frag_start_ms, x.frag_end_ms, x.diff_ms) for x in got.collect()} == {k: v[1] for k, v in want.items()}
    copies = match.match_fragments(cues.crossJoin(spark.range(30)).selectExpr("track", "cue_id + 10000 * id as cue_id", "start_ms", "end_ms"), frags.crossJoin(spark.range(30)).selectExpr("track", "frag_id + 10000 * id as frag_id", "start_ms", "end_ms"), ("track",))
    assert {(x.track, x.cue_id): (x.frag_id, x.diff_ms) for x in copies.where("cue_id < 10000").collect()} == {k: (v[1][0], v[1][3]) for k, v in want.items()}
    assert "_bucket" not in got._jdf.queryExecution().toString()


def test_match_joins_no_pairs_and_puts_unknown_ends_last(spark):
    cues = spark.createDataFrame([(1, 1000, 2000)], "cue_id long, start_ms long, end_ms long")
    frags = spark.createDataFrame([(5, 1000, None), (7, 1200, 2000)], "frag_id long, start_ms long, end_ms long")
    got = match.match_fragments(cues, frags)
    assert [(r.frag_id, r.diff_ms) for r in got.collect()] == [(7, 200)]
    assert "frag_start_ms" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_usable_cues_and_files(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "\n"), (3, None), (4, "x")], "cue_id long, text string")
    assert sorted((r.cue_id, r.target_text, r.source_text) for r in match.usable_cues(df).collect()) == [(1, "a", "b"), (4, "x", "x")]


def test_wav_round_trip(spark, tmp_path):
    x = (np.sin(np.arange(1600) / 5) * 0.5).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(wav.encode_wav(x, 16000))
    row = wav.read_wav(spark, str(tmp_path / "a.wav")).first()
    assert (row.sample_rate, row.channels, row.n_samples) == (16000, 1, 1600)
    assert np.abs(np.array(row.pcm) - x).max() < 1e-4
    again = wav.encoded(wav.read_wav(spark, str(tmp_path / "a.wav"))).first().wav
    assert bytes(again)[:44] == wav.encode_wav(x, 16000)[:44]
    with pytest.raises(ValueError):
        wav.decode_wav(b"no wav at all")


def test_resampling_keeps_a_tone():
    t = np.arange(1600) / 16000
    x = np.sin(2 * np.pi * 100 * t).astype(np.float32)
    up = audio.resampled(x, 16000, 32000)
    assert len(up) == 3200 and np.abs(up - np.sin(2 * np.pi * 100 * np.arange(3200) / 32000)).max() < 1e-3
    down = audio.resampled(x, 16000, 8000)
    assert len(down) == 800 and np.abs(down - x[::2]).max() < 1e-3
    assert (audio.to_mono(np.array([1, 3, 5, 7], np.float32), 2) == [2, 6]).all()


def test_mix_down_overwrites_and_cuts(spark):
    seg = spark.createDataFrame([("m", 2, 1000, 10, [2.0] * 20), ("m", 1, 0, 10, [1.0] * 15), ("m", 3, 9900, 10, [3.0] * 9), ("m", 4, 99_000, 10, [4.0])], "media_id string, ord long, start_ms long, sample_rate int, pcm array<float>")
    media = spark.createDataFrame([("m", 10_000, 10), ("silent", 500, 10)], "media_id string, total_ms long, sample_rate int")
    got = {m: np.concatenate([r.pcm for r in audio.mix_down(seg, media, frame=8).where(F.col("media_id") == m).orderBy("frame_no").collect()]) for m in ("m", "silent")}
    want = np.zeros(100)
    want[0:15], want[10:30], want[99:] = 1, 2, 3
    assert (got["m"] == want).all() and (got["silent"] == np.zeros(5)).all()


def test_mix_down_makes_samples_once_and_joins_no_media(spark):
    """What makes the samples stands once in the plan, and no join by medium gathers one medium's segments in one task."""
    pcm = F.expr("transform(sequence(0, id % 20), i -> cast((id * 31415 + i) % 97 + 1 as float))")
    seg = spark.range(60).select(F.expr("cast(id % 2 as string)").alias("media_id"), F.col("id").alias("ord"), (F.col("id") * 700 % 9000 - 500).alias("start_ms"), F.lit(10).alias("sample_rate"), pcm.alias("pcm"))
    media = spark.createDataFrame([("0", 8_300, 10), ("1", 7_000, 10)], "media_id string, total_ms long, sample_rate int")
    mix = audio.mix_down(seg, media, frame=16)
    plan = mix._jdf.queryExecution().executedPlan().toString()
    assert plan.count("31415") == 1 and "Join" not in plan
    odd = spark.createDataFrame([("0", 100, 0, 10, None), ("0", 101, 0, 10, []), ("0", 102, 8_200, 10, [1.0, None, 5.0]), ("0", 103, 8_500, 10, [7.0] * 30), ("2", 1, 0, 10, [1.0]), (None, 1, 0, 10, [1.0])], seg.schema)
    every = seg.unionByName(odd)
    want = {"0": np.zeros(83, np.float32), "1": np.zeros(70, np.float32)}
    for r in every.orderBy("ord").collect():
        for i, x in enumerate(r.pcm or []):
            if r.media_id in want and 0 <= (at := r.start_ms // 100 + i) < len(want[r.media_id]):
                want[r.media_id][at] = np.nan if x is None else x
    got = audio.mix_down(every, media, frame=16).orderBy("media_id", "frame_no").collect()
    for m, x in want.items():
        assert np.array_equal(np.concatenate([r.pcm for r in got if r.media_id == m]), x, equal_nan=True)
    assert {r.media_id for r in got} == {"0", "1"}


def test_conform(spark):
    seg = spark.createDataFrame([("m", 0, 0, 8000, 2, [0.5, 0.5] * 80)], "media_id string, ord long, start_ms long, sample_rate int, channels int, pcm array<float>")
    r = audio.conform(seg, 16000).first()
    assert r.sample_rate == 16000 and len(r.pcm) == 160 and abs(r.pcm[80] - 0.5) < 1e-3


def test_timeline_files(spark, tmp_path):
    frags = spark.createDataFrame([("m", 0, "a.wav", 0, 1500), ("m", 1, "b.wav", 2000, 2750)], "media_id string, frag_id long, file string, start_ms long, end_ms long")
    media = spark.createDataFrame([("m", "v.mp4", 3000, 16000, "out")], "media_id string, input_file string, total_ms long, sample_rate int, output_dir string")
    for export in (False, True):
        raw = documents.timeline_json(frags, media, export).first().json
        assert (json.loads(raw)["fragments" if export else "timeline"][1])["end"] == 2.75
        p = tmp_path / f"t{export}.json"
        p.write_text(raw)
        assert [(r.frag_id, r.file, r.start_ms, r.end_ms) for r in documents.read_timeline(spark, str(p)).orderBy("frag_id").collect()] == [(0, "a.wav", 0, 1500), (1, "b.wav", 2000, 2750)]
    files = spark.createDataFrame([("a.wav",)], "file string")
    assert documents.complete_timeline(frags, files).count() == 0
    assert documents.complete_timeline(frags, frags.select("file")).count() == 2


def test_html_is_escaped_and_lists_what_exists(spark):
    files = spark.createDataFrame([("p", 1, "<b>", "1.wav"), ("p", 2, "x", "2.wav")], "page string, position long, label string, file string")
    html = documents.html_index(files, files.where("position = 1").select("file")).first().html
    assert "&lt;b&gt;" in html and "2.wav" not in html


def test_providers(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "id long, text string")
    stub = providers.StubProvider("answer", fail_every=5)
    rows = providers.enrich(df, stub, ["id", "text"], "answer string", calls_at_once=2, retries=0).collect()
    want = {k: (stub.call([{"id": k, "text": f"t{k}"}])[0] or {}).get("answer") for k in range(50)}
    assert {r.id: r.answer for r in rows} == want and None in want.values()
    t = np.arange(16000) / 16000
    tone = np.where((t > 0.2) & (t < 0.7), np.sin(t * 3000), 0).astype(np.float32)
    got = providers.EnergyVad().call([{"pcm": tone, "sample_rate": 16000}])[0]
    assert len(got["starts"]) == 1 and abs(got["starts"][0] - 200) <= 10 and abs(got["ends"][0] - 700) <= 10


def test_grid_names_summary(spark):
    t = spark.createDataFrame([("hi",)], "text string")
    assert [r.speaker_id for r in grid.speaker_grid(t, 198, 199).collect()] == [198, 199]
    for bad in ((5, 4), (-1, 3), (0, 200)):
        with pytest.raises(ValueError):
            grid.speaker_grid(t, *bad)
    r = spark.range(1).select(languages.output_name(F.lit("v"), F.lit("a"), F.lit("b"), "clone").alias("c"), languages.refined_name(F.lit("v.a-b.srt")).alias("r")).first()
    assert (r.c, r.r) == ("v.b.cloned.wav", "v.a-b.refined.srt")


def test_concatenation_in_pieces_is_the_concatenation(spark):
    r = random.Random(8)
    rows = [(m, k, [float(r.randrange(9)) for _ in range(r.randrange(0, 6))]) for m, n in (("a", 40), ("b", 7), (None, 9), ("c", 3)) for k in range(n)]
    rows += [("a", 5, [1.0, 2.0]), ("c", 3, None)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "media_id string, chunk_no long, pcm array<float>")
    whole = {x.media_id: x.pcm for x in audio.concat_chunks(df).collect()}
    got: dict = {}
    for x in sorted(audio.concat_pieces(df, per_block=4).collect(), key=lambda x: (x.media_id or "", x.first_sample, len(x.pcm))):
        out = got.setdefault(x.media_id, [])
        assert x.first_sample == len(out)
        out += x.pcm
    assert whole.pop("c") is None and got == whole
    assert audio.concat_pieces(df.where("false")).count() == 0
