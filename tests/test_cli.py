import json

import numpy as np

from cuelake.__main__ import main
from cuelake.sources import wav


def text_under(path):
    return [p.read_text() for p in path.rglob("part-*")]


def test_srt_and_check(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.srt").write_text("2\n00:00:05,000 --> 00:00:06,000\nlater\n\n1\n00:00:01,000 --> 00:00:01,200\nfirst\n\n3\n00:00:09,000 --> 00:00:08,000\nback\n")
    assert main(["srt", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 0
    (got,) = text_under(tmp_path / "out")
    assert got.startswith("1\n00:00:01,000 --> 00:00:01,200\nfirst\n\n2\n00:00:05,000 --> 00:00:06,000\nlater\n")
    assert main(["check", str(tmp_path / "in"), str(tmp_path / "issues")], spark) == 0
    assert any(t.strip() for t in text_under(tmp_path / "issues"))
    assert main(["srt", str(tmp_path / "missing"), str(tmp_path / "x")], spark) == 1


def test_segment(spark, tmp_path):
    (tmp_path / "in").mkdir()
    x = np.zeros(16_000 * 3, np.float32)
    x[8000:24_000] = 0.5
    x[32_000:40_000] = -0.5
    (tmp_path / "in/a.wav").write_bytes(wav.encode_wav(x, 16_000))
    assert main(["segment", str(tmp_path / "in"), str(tmp_path / "out"), "--chunk-ms", "1000"], spark) == 0
    (line,) = [t for t in text_under(tmp_path / "out/timelines") if t.strip()]
    made = json.loads(line)
    assert [(f["start"], f["end"]) for f in made["fragments"]] == [(0.5, 1.5), (2.0, 2.5)] and made["total_duration"] == 3.0
    assert sorted(f["file"] for f in made["fragments"]) == sorted(p.name for p in (tmp_path / "out/fragments").iterdir())
