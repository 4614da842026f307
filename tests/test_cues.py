import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.operators import cues, greedy, ordered
from cuelake.sources import srt
from pyspark.sql import functions as F

SCHEMA = "track string, cue_id long, start_ms long, end_ms long, text string"


def spec_merge(rows, min_ms=500, max_ms=7000):
    """Greedy merging of one track's cues (start, cue_id, end, text) in order."""
    out, buf = [], None
    for start, cid, end, text in sorted(rows):
        if end - start < min_ms:
            if buf and end - buf[0] <= max_ms:
                buf = (buf[0], end, f"{buf[2]} {text}", buf[3], buf[4] + 1)
            else:
                out += [buf] if buf else []
                buf = (start, end, text, cid, 1)
        else:
            out += [buf] if buf else []
            buf = None
            out.append((start, end, text, cid, 1))
    return sorted(out + ([buf] if buf else []))


def merged(spark, rows, **options):
    df = spark.createDataFrame([("t", c, s, e, x) for s, c, e, x in rows], SCHEMA)
    return sorted((r.start_ms, r.end_ms, r.text, r.cue_id, r.n_merged) for r in cues.merge_short(df, **options).collect())


def test_merge_equals_spec_on_random_tracks(spark):
    r = random.Random(3)
    for n in (0, 1, 40, 300):
        rows = [(r.randrange(0, 40_000), k, 0, f"c{k}") for k in range(n)]
        rows = [(s, k, s + r.choice((0, 100, 400, 499, 500, 900, 3000)), t) for s, k, _, t in rows]
        assert merged(spark, rows) == spec_merge(rows)


def small_blocks(monkeypatch, bits=4, fan=3):
    """Blocks of 2^bits rows and a tree of a few nodes a task, so that few rows are many of both."""
    monkeypatch.setattr(ordered, "BLOCK_BITS", bits)
    monkeypatch.setattr(greedy, "FAN", fan)


def test_one_island_over_many_blocks(spark, monkeypatch):
    small_blocks(monkeypatch)
    rows = [(k * 50, k, k * 50 + 40, "x") for k in range(2000)]
    assert merged(spark, rows) == spec_merge(rows)


def test_groups_that_span_many_blocks(spark, monkeypatch):
    """Cues so dense that a block passes on the group that is open before it, and ties."""
    small_blocks(monkeypatch)
    r = random.Random(4)
    rows = [(r.randrange(0, 30_000) // 10 * 10, k, 0, str(k)) for k in range(1500)]
    rows = [(s, k, s + r.choice((-300, 0, 30, 499)), t) for s, k, _, t in rows]
    assert merged(spark, rows) == spec_merge(rows)
    assert merged(spark, rows, max_ms=90) == spec_merge(rows, max_ms=90)


def test_tracks_meet_within_a_block_and_at_its_border(spark, monkeypatch):
    small_blocks(monkeypatch)
    r = random.Random(5)
    tracks = {t: sorted((r.randrange(0, 60_000), k) for k in range(n)) for t, n in ((None, 33), ("", 48), ("a", 1), ("b", 250), ("c", 16), ("d", 90))}
    rows = [(t, k, s, s + (700 if t == "d" and k % 20 == 0 else 60), f"{k}") for t, cs in tracks.items() for s, k in cs]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.track is None, r.track or "", r.start_ms, r.end_ms, r.text, r.cue_id, r.n_merged) for r in cues.merge_short(df).collect()))
    want = [(t is None, t or "", *m) for t in tracks for m in spec_merge([(s, k, e, x) for u, k, s, e, x in rows if u == t])]
    assert got == sorted(want)


def test_cues_without_times_are_left_out_and_none_are_no_error(spark):
    df = spark.createDataFrame([("t", 1, None, 5, "a"), ("t", 2, 5, None, "b"), ("t", 3, 10, 20, None), ("t", 4, 30, 40, "d")], SCHEMA)
    assert [(r.start_ms, r.end_ms, r.text, r.cue_id, r.n_merged) for r in cues.merge_short(df).collect()] == [(10, 40, " d", 3, 2)]
    assert cues.merge_short(df.where("false")).count() == 0


def test_functions_of_blocks_equal_the_fold():
    """Every start that can be open before a block, through one block and through two composed ones."""
    r = random.Random(6)
    for _ in range(300):
        n, max_ms = r.randrange(1, 30), r.choice((0, 40, 200, 3000))
        start = sorted(r.randrange(0, 2000) for _ in range(2 * n))
        end = [s + r.choice((-50, 0, 10, 150)) for s in start]
        short, new = [r.random() > 0.03 for _ in start], [r.random() < 0.02 for _ in start]
        new[0] = new[n] = False
        parts = [greedy._step_function(start[i : i + n], end[i : i + n], short[i : i + n], new[i : i + n], list(range(i, i + n)), max_ms) for i in (0, n)]
        both = greedy._compose(*parts, start[0])
        for begin, at in [(-greedy.NEVER, greedy.CLOSED)] + [(start[0] - d, 999) for d in range(0, 3200, 7)]:
            b, a = begin, at
            for k in range(2 * n):
                if new[k] or not short[k]:
                    b, a = -greedy.NEVER, greedy.CLOSED
                if short[k] and end[k] - b > max_ms:
                    b, a = start[k], k
                if k == n - 1:
                    assert greedy._after(parts[0], [s[0] for s in parts[0]], begin, at) == (b, a)
            assert greedy._after(both, [s[0] for s in both], begin, at) == (b, a)


def test_pauses_part_a_track_of_short_cues(spark, monkeypatch):
    small_blocks(monkeypatch, 6, 5)
    r = random.Random(9)
    at, rows = 0, []
    for k in range(3000):
        at += r.choice((0, 50, 300, 6_700, 6_950, 7_000, 8_000))
        rows.append((at, k, at + r.choice((0, 50, 499)), f"c{k}"))
    assert merged(spark, rows) == spec_merge(rows)


def test_island_across_blocks(spark):
    rows = [(cues.BLOCK_MS - 300 + k * 100, k, cues.BLOCK_MS - 250 + k * 100, str(k)) for k in range(8)]
    assert merged(spark, rows) == spec_merge(rows)


def test_merge_by_line(spark):
    rows = [(0, 1, 100, "a\nb"), (200, 2, 300, "c\nd")]
    assert merged(spark, rows, by_line=True)[0][2] == "a c\nb d"
    assert merged(spark, rows)[0][2] == "a\nb c\nd"
    uneven = [(0, 1, 100, "a\nb"), (200, 2, 300, "c")]
    assert merged(spark, uneven, by_line=True)[0][2] == "a\nb c"


def test_issues(spark):
    rows = [("t", 0, 0, 1000, "a"), ("t", 1, 900, 900, "b"), ("t", 2, -5, -9, None), ("t", 3, None, 4000, "d"), ("t", 4, 3000, None, "e")]
    df = spark.createDataFrame(rows, "track string, ord long, start_ms long, end_ms long, text string")
    got = {(r.position, r.issue) for r in cues.timing_issues(df, per_block=2).collect()}
    assert got == {(0, "overlap"), (1, "end_not_after_start"), (1, "overlap"), (2, "missing_text"), (2, "negative_start"), (2, "negative_end"), (2, "end_not_after_start"), (3, "missing_start"), (3, "overlap"), (4, "missing_end")}


def test_bilingual_share_of_first_five(spark):
    rows = [("a", k, "x\ny" if k != 1 else "x") for k in range(6)] + [("b", 0, "x"), ("c", 0, None)]
    df = spark.createDataFrame(rows, "track string, ord long, text string")
    assert {(r.track, r.n, r.n_two_lines, r.is_bilingual) for r in cues.bilingual_share(df).collect()} == {("a", 5, 4, True), ("b", 1, 0, False), ("c", 1, 0, False)}


def test_running_sum_spreads_a_hot_key(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), "id")
    got = ordered.running_sum(df, ["k"], ["id"], F.floor(F.col("id") / 50), F.col("id"), "s")
    assert all(r.s == r.id * (r.id + 1) // 2 for r in got.collect())
    assert "hashpartitioning(k#" in got._jdf.queryExecution().toString() and "_block" in got._jdf.queryExecution().toString()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**7), st.integers(1, 10**5)), min_size=1, max_size=20, unique_by=lambda x: x[0]))
def test_render_and_parse_are_inverse(spark, spans):
    spans = sorted(spans)
    df = spark.createDataFrame([("t", k, s, s + d, f"line {k}") for k, (s, d) in enumerate(spans)], SCHEMA)
    back = srt.parse_srt(srt.render_srt(df, merge=False)).orderBy("ord").collect()
    assert [(r.cue_index, r.start_ms, r.end_ms, r.text) for r in back] == [(k + 1, s, s + d, f"line {k}") for k, (s, d) in enumerate(spans)]
