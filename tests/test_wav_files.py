import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.operators import audio, resample
from cuelake.sources import store, wav, wav_files

PIECES = "media_id string, first_sample long, sample_rate int, pcm array<float>"


def whole(rows):
    """Samples per medium, put together by their places."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.media_id, r.first_sample)):
        x = out.setdefault(r.media_id, [])
        assert r.first_sample * (r.channels if "channels" in r else 1) == len(x)
        x += r.pcm
    return out


def stereo(n):
    return (np.arange(2 * n) % 251 - 125).astype("<i2")


def file_of(chunks, kind=b"RIFF"):
    body = b"".join(name + struct.pack("<I", size if size is not None else len(data)) + data + b"\0" * (len(data) & 1) for name, data, size in chunks)
    return kind + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


FMT = struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)


@pytest.mark.parametrize(("split", "piece"), [(1000, 64), (37, 1000), (1 << 20, 7)])
def test_byte_ranges_give_the_whole_file(spark, tmp_path, split, piece):
    x = stereo(501)
    long = struct.pack("<HHIIHHHHIH14s", 0xFFFE, 2, 8000, 32000, 4, 16, 22, 16, 3, 1, b"\0" * 14)
    files = {
        "plain": file_of([(b"fmt ", FMT, None), (b"data", x.tobytes(), None)]),
        "odd": file_of([(b"LIST", b"abc", None), (b"data", x.tobytes(), None), (b"junk", b"x", None), (b"fmt ", long, None)]),
        "cut": file_of([(b"fmt ", FMT, None), (b"data", x.tobytes()[:-3], len(x) * 2)])[:-1],
        "stream": file_of([(b"fmt ", FMT, None), (b"data", x.tobytes(), 0xFFFFFFFF)]),
        "large": file_of([(b"ds64", struct.pack("<QQQI", 0, len(x) * 2, 0, 0), None), (b"fmt ", FMT, None), (b"data", x.tobytes(), 0xFFFFFFFF), (b"tail", b"abcd", None)], b"RF64"),
        "none": file_of([(b"fmt ", FMT, None), (b"data", b"", None)]),
    }
    for name, raw in files.items():
        (tmp_path / f"{name}.WAV").write_bytes(raw)
    (tmp_path / "note.txt").write_text("not audio")
    df = wav_files.read_pieces(spark, str(tmp_path), split, piece)
    rows = df.collect()
    got = {k.rpartition("/")[2][:-4]: v for k, v in whole(rows).items()}
    want = (x / 32768).tolist()
    assert got == {"plain": want, "odd": want, "cut": want[:-2], "stream": want, "large": want}
    assert max(len(r.pcm) for r in rows) <= 2 * piece and {(r.sample_rate, r.channels) for r in rows} == {(8000, 2)}
    if split == 1000:
        assert df.rdd.getNumPartitions() >= 10
    one = wav_files.mono(df.where(F.col("media_id").endswith("plain.WAV"))).collect()
    assert np.allclose(whole(one).popitem()[1], (x.reshape(-1, 2) / 32768).mean(1), atol=1e-7)


def test_what_is_no_wav_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"RIFX0000WAVE")
    with pytest.raises(Exception, match="not a WAV file"):
        wav_files.read_pieces(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="FileNotFound|missing"):
        wav_files.read_pieces(spark, str(tmp_path / "missing")).collect()


def test_mix_as_a_file_equals_its_frames(spark, tmp_path):
    r = np.random.default_rng(2)
    seg = spark.createDataFrame([("a/b", 1, 0, 100, r.random(150).astype(np.float32).tolist()), ("a/b", 2, 900, 100, [0.5] * 30), ("c", 1, 40, 100, [-2.0, 2.0])], "media_id string, ord long, start_ms long, sample_rate int, pcm array<float>")
    media = spark.createDataFrame([("a/b", 2000, 100), ("c", 505, 100)], "media_id string, total_ms long, sample_rate int")
    frames = audio.mix_down(seg, media, frame=32).select("media_id", (F.col("frame_no") * 32).alias("first_sample"), F.lit(100).alias("sample_rate"), "pcm").persist()
    listing = {x.media_id: x for x in wav_files.write_wav(frames.repartition(5), str(tmp_path / "out")).collect()}
    for m, x in whole(frames.collect()).items():
        raw = (tmp_path / "out" / listing[m].file).read_bytes()
        assert raw == wav.encode_wav(np.array(x, np.float32), 100) and listing[m].n_bytes == len(raw) and listing[m].n_samples == len(x)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_listing")) == ["a%2Fb.wav", "c.wav"]
    assert wav_files.write_wav(frames.limit(0), str(tmp_path / "empty")).count() == 0


def test_media_are_put_together_in_tasks_of_their_own(spark, tmp_path):
    pieces = spark.createDataFrame([(f"m{k}", 0, 8, [k / 16] * 5) for k in range(12)], PIECES)
    listing = wav_files.write_wav(pieces, str(tmp_path / "out"))
    assert listing.count() == 12 and listing.select(F.input_file_name()).distinct().count() > 1
    assert {r.media_id.rpartition("/")[2]: r.pcm for r in wav_files.read_pieces(spark, str(tmp_path / "out")).collect()} == {f"m{k}.wav": [float(np.rint(k / 16 * 32767)) / 32768] * 5 for k in range(12)}


def test_failed_and_repeated_tasks_leave_nothing(spark, tmp_path):
    """A task's first attempt writes a part and is lost; the second one's part alone counts."""
    target = tmp_path / "parts"
    w = wav_files.WavSource({"path": str(target)}).writer(None, False)
    batch = spark.createDataFrame([("m", 0, 8, [0.5, 0.25])], PIECES).toArrow().to_batches()
    lost, good = w.write(iter(batch)), w.write(iter(batch))
    w.commit([good, None])
    assert lost.name != good.name and good.name in (target / "_committed").read_text() and lost.name not in (target / "_committed").read_text()
    w.abort([good])
    assert not target.exists()

    flag = tmp_path / "failed"

    @F.udf("bigint")
    def broken(x):
        if x > 50:
            flag.write_text("x")
            raise RuntimeError("lost")
        return x

    rows = spark.range(100, numPartitions=4).select(F.lit("m").alias("media_id"), broken("id").alias("first_sample"), F.lit(8).alias("sample_rate"), F.array(F.lit(0.5)).cast("array<float>").alias("pcm"))
    with pytest.raises(Exception, match="lost"):
        wav_files.write_wav(rows, str(tmp_path / "out"))
    assert flag.exists() and not list((tmp_path / "out").glob("*"))
    hole = spark.createDataFrame([("m", 0, 8, [0.5]), ("m", 2, 8, [0.5])], PIECES)
    with pytest.raises(Exception, match="don't cover it"):
        wav_files.write_wav(hole, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*.wav")) and not list((tmp_path / "out").glob("_parts*"))


def test_paths_by_uri(tmp_path):
    (tmp_path / "x.wav").write_bytes(b"12")
    assert store.files_under(f"file://{tmp_path}", ".wav") == store.files_under(str(tmp_path), ".wav") or len(store.files_under(f"file://{tmp_path}", ".wav")) == 1


def cut(x, sizes):
    at, out = 0, []
    for k in range(10**6):
        if at >= len(x):
            return out
        n = sizes[k % len(sizes)]
        out.append((at, x[at : at + n]))
        at += n


@pytest.mark.parametrize(("source", "target"), [(44100, 16000), (8000, 16000), (1000, 500), (16000, 16000), (7, 5)])
def test_every_cut_resamples_alike(spark, source, target):
    r = np.random.default_rng(source)
    x = r.standard_normal(3001).astype(np.float32)
    want = None
    for sizes, block in (([3001], 1 << 16), ([400, 1, 37], 100), ([64], 257)):
        df = spark.createDataFrame([("m", a, source, p.tolist()) for a, p in cut(x, sizes)] + [("m", 0, source, None), ("m", 5, source, [])], PIECES)
        got = np.array(whole(resample.resample(df, target, block).collect())["m"])
        assert len(got) == len(x) * target // source
        want = got if want is None else want
        assert np.abs(got - want).max() < 1e-5


def test_resampling_keeps_a_tone_and_removes_what_cannot_be_kept(spark):
    t = np.arange(4000)
    low, high = np.sin(2 * np.pi * 100 * t / 8000), np.sin(2 * np.pi * 3500 * t / 8000)
    df = spark.createDataFrame([("m", a, 8000, p.tolist()) for a, p in cut((low + high).astype(np.float32), [333])], PIECES)
    got = np.array(whole(resample.resample(df, 4000, 500).collect())["m"])
    inner = slice(100, -100)
    assert np.abs(got - low[::2])[inner].max() < 2e-3


def test_a_hole_stays_a_hole(spark):
    df = spark.createDataFrame([("m", 0, 10, [1.0] * 100), ("m", 300, 10, [1.0] * 100), ("n", 0, 20, [1.0] * 100)], PIECES)
    got = sorted((r.media_id, r.first_sample, r.sample_rate, len(r.pcm)) for r in resample.resample(df, 20, 64).collect())
    assert sum(n for m, _, _, n in got if m == "m") == 400 and {r for _, _, r, _ in got} == {20}
    assert [g for g in got if g[0] == "n"] == [("n", 0, 20, 100)]
