import re

from pyspark.sql import functions as F

from cuelake.functions import languages, text, timecode
from cuelake.sources import srt


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def spec_clean(t, width=80):
    out = []
    for line in (t or "").strip().split("\n"):
        line = re.sub(" +", " ", line.strip())
        if len(line) <= width:
            out.append(line)
            continue
        now = []
        for w in line.split():
            if now and len(" ".join([*now, w])) > width:
                out.append(" ".join(now))
                now = []
            now.append(w)
        out.append(" ".join(now))
    return "\n".join(out)


def test_clean_text(spark):
    long = "word " * 40
    cases = ["", None, "  a   b  ", "a\tb", "x\n\n y ", long, "z" * 100, f"short\n{long}\n{'q' * 90} tail", "字" * 120, "a " + "b" * 85 + " c"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(text.clean_text(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [spec_clean(c) for c in cases]


def test_timecodes(spark):
    f = timecode.format_timecode
    assert one(spark, f(F.lit(4354).cast("bigint"))) == "00:00:04,354"
    assert one(spark, f(F.lit(-5).cast("bigint"))) == "00:00:00,000"
    assert one(spark, f(F.lit(-1500).cast("bigint"), clamp=False)) == "-00:00:01,500"
    assert one(spark, f(F.lit(360_000_123).cast("bigint"))) == "100:00:00,123"
    assert one(spark, timecode.format_seconds(F.lit(125.678))) == "00:02:05,677"  # as binary fractions have it
    p = timecode.parse_timecode
    for code, strict, lenient in (("00:00:04,354", 4354, 4354), ("1:2:3,5 X1:9", 3723005, 3723005), ("00:00:01.5", None, None), ("bad", None, None), ("0:01,5", None, None)):
        assert one(spark, p(F.lit(code))) == strict
        assert one(spark, p(F.lit(code), "lenient")) == lenient


def test_pairs(spark):
    assert tuple(one(spark, text.bilingual_pair(F.lit(" a \n b \nc")))) == ("a", "b")
    assert tuple(one(spark, text.bilingual_pair(F.lit("a")))) == ("a", "a")
    assert tuple(one(spark, text.bilingual_pair(F.lit("")))) == ("", "")
    assert tuple(one(spark, text.exact_pair(F.lit("a\nb\nc")))) == ("a\nb\nc", "")
    assert one(spark, text.compose(F.lit("t"), F.lit(None).cast("string"))) == f"t\n{text.NO_SOURCE}"
    assert one(spark, text.compose(F.lit(""), F.lit("s"))) == f"{text.NO_TARGET}\ns"
    assert one(spark, text.compose(F.lit(""), F.lit(""))) is None
    assert one(spark, text.preview(F.lit("a" * 50 + "\nb"))) == "a" * 45 + "... | b"


def test_languages(spark):
    assert tuple(one(spark, languages.language_pair(F.lit(" a : b ")))) == ("a", "b")
    for bad in ("a", "a:", ":b", "a:b:c", ""):
        assert one(spark, languages.language_pair(F.lit(bad))) is None
    assert tuple(one(spark, languages.languages_of_stem(F.lit("v.en-cmn")))) == ("en", "cmn")
    assert one(spark, languages.languages_of_stem(F.lit("v.EN-cmn"))) is None
    assert tuple(one(spark, languages.languages_of_file(F.lit("v.ENG-cmn.srt")))) == ("eng", "cmn")
    assert tuple(one(spark, languages.languages_of_file(F.lit("v.eng-cmn.refined.srt")))) == ("eng", "cmn")
    assert one(spark, languages.languages_of_file(F.lit("test.srt"))) is None


def cues_of(spark, content, **options):
    df = spark.createDataFrame([("f", content)], "track string, content string")
    return [(r.cue_index, r.start_ms, r.end_ms, r.text) for r in srt.parse_srt(df, **options).orderBy("ord").collect()]


def test_strict_and_lenient_dialects(spark):
    a = "1\n00:00:01,000 --> 00:00:02,000\nhi\nyou\n\n\n2\n00:00:03,000 --> 00:00:04,000 X1:3\nho\n"
    assert cues_of(spark, a) == cues_of(spark, a, dialect="lenient") == [(1, 1000, 2000, "hi\nyou"), (2, 3000, 4000, "ho")]
    crlf = a.replace("\n", "\r\n")
    assert cues_of(spark, crlf, dialect="lenient") == [(1, 1000, 2000, "hi\nyou"), (2, 3000, 4000, "ho")]
    bom = chr(0xFEFF) + a
    assert len(cues_of(spark, bom)) == 1 and len(cues_of(spark, bom, dialect="lenient")) == 2
    odd = "12abc\n00:00:01,000 --> 00:00:02,000\nx\n \n3\n00:00:05,000 --> 00:00:06,000\ny"
    assert cues_of(spark, odd) == [] and len(cues_of(spark, odd, dialect="lenient")) == 2
    assert cues_of(spark, "1\n00:00:01,000 --> 00:00:02,000") == []
    assert cues_of(spark, "") == [] and cues_of(spark, None) == []
    df = spark.createDataFrame([("f", "0\n00:00:01.000 --> 00:00:02,000\nx")], "track string, content string")
    assert srt.parse_srt(df, mode="permissive").first().corrupt.startswith("0\n")


def test_files_round_trip(spark, tmp_path):
    content = "5\n00:00:01,000 --> 00:00:02,000\na\nb\n\n7\n00:00:00,500 --> 00:00:03,000\nc\n"
    (tmp_path / "x.srt").write_text(content, encoding="utf-8")
    cues = srt.read_srt(spark, str(tmp_path))
    assert srt.render_as_parsed(cues).first().content == content
    srt.write_srt(srt.render_as_parsed(cues).withColumn("track", F.lit("x")), str(tmp_path / "out"))
    assert content.strip() in (next((tmp_path / "out" / "track=x").glob("*.txt"))).read_text(encoding="utf-8")


def test_long_runs_of_blanks_cost_their_length(spark):
    """A pattern that is tried anew at every blank would not come to an end here."""
    gap = " " * 200_000
    rows = [(1, f"a{gap}b"), (2, f"{gap}a{gap}\n{gap}"), (3, gap)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, x string").select("i", text.clean_text(F.col("x")).alias("t")).collect()}
    assert got == {1: "a b", 2: "a", 3: ""}
    content = f"1\n00:00:01,000{gap}-->{gap}00:00:02,000\nx\n\n2\n00:00:01,000{gap}\ny\n\n3\n{'z' * 200_000}\nt\n"
    for dialect in ("strict", "lenient"):
        cues = srt.parse_srt(spark.createDataFrame([("f", content)], "track string, content string"), dialect)
        assert [(r.cue_index, r.start_ms, r.end_ms, r.text) for r in cues.collect()] == [(1, 1000, 2000, "x")]


def test_parts_of_a_track_are_its_file(spark, tmp_path):
    rows = [(t, k, k * 900, k * 900 + (100 if k % 7 == 0 else 800), f"cue {k} of {t}") for t, n in (("long", 300), ("short one", 2)) for k in range(n)]
    df = spark.createDataFrame(rows, "track string, cue_id long, start_ms long, end_ms long, text string")
    srt.write_srt(srt.render_srt(df), str(tmp_path / "whole"))
    srt.write_srt_parts(df, str(tmp_path / "parts"))
    read = lambda kind, t: [f.read_bytes() for f in sorted((tmp_path / kind / f"track={t}").glob("part-*"))]
    for t in ("long", "short one"):
        assert b"".join(read("parts", t)) == b"".join(read("whole", t)) != b""
    assert len(read("parts", "long")) > 1
