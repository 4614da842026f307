import pytest
from pyspark.sql import functions as F

from cuelake.operators import refine
from cuelake.operators.call_log import CallLog

CALLS = "track string, call_seq long, name string, pos long, first_text string, second_text string"


def state(spark, n=20, done=()):
    df = spark.createDataFrame([("t", k, f"a{k}\nb{k}") for k in range(1, n + 1)], "track string, pos long, text string")
    return refine.new_state(df).withColumn("state", F.when(F.col("pos").isin(list(done)), "finished").otherwise(F.col("state")))


def spec_window(first, total, size, preferred=None):
    low = first - size // 2
    start = max(low if preferred is None else max(preferred, low), 1)
    end = start + size - 1
    return (max(1, total - size + 1), total) if end > total else (start, end)


def test_window_bounds(spark):
    cases = [(f, n, w) for n in (1, 7, 20) for w in (1, 4, 10) for f in range(1, n + 1)]
    df = spark.createDataFrame(cases, "f long, n long, w int")
    for w in (1, 4, 10):
        for r in df.where(F.col("w") == w).select("f", "n", refine.window_bounds(F.col("f"), F.col("n"), w).alias("b"), refine.window_bounds(F.col("f"), F.col("n"), w, F.col("f") + 1).alias("p")).collect():
            assert tuple(r.b) == spec_window(r.f, r.n, w) and tuple(r.p) == spec_window(r.f, r.n, w, r.f + 1)


def test_schedule_is_the_simulated_one(spark):
    for n, w in ((30, 10), (17, 5), (9, 1), (12, 4)):
        done, want, rounds = set(), {}, 0
        while len(done) < n:
            rounds += 1
            a, b = spec_window(min(set(range(1, n + 1)) - done), n, w)
            for p in set(range(a, b + 1)) - done:
                want[p] = rounds
            done |= set(range(a, b + 1))
        got = spark.range(1, n + 1).select("id", refine.schedule_round(F.col("id"), w).alias("r")).collect()
        assert {r.id: r.r for r in got} == want


def test_calls(spark):
    rows = [("t", 1, refine.KEEP, 1, None, None), ("t", 2, refine.CHANGE, 2, "f", "s"), ("t", 3, refine.CHANGE, 2, "f2", "s2"), ("t", 4, refine.CHANGE, 3, "", "s"), ("t", 5, "what", 4, "f", "s"), ("t", 6, refine.KEEP, 0, None, None), ("t", 7, refine.CHANGE, 5, "f5", "s5"), ("t", 8, refine.KEEP, 99, None, None), ("t", 9, refine.KEEP, 2, None, None)]
    got = {r.pos: (r.state, r.text) for r in refine.apply_calls(state(spark, 6, done=(5,)), spark.createDataFrame(rows, CALLS)).collect()}
    assert got == {1: ("finished", "a1\nb1"), 2: ("finished", "s2\nf2"), 3: ("unfinished", "a3\nb3"), 4: ("unfinished", "a4\nb4"), 5: ("finished", "s5\nf5"), 6: ("unfinished", "a6\nb6")}


def saver(path):
    return lambda s, n: refine.save_checkpoint(s, str(path), "in.srt", n)


def keep_all(entries, retry):
    return entries.where("state = 'unfinished'").select("track", F.col("pos").alias("call_seq"), F.lit(refine.KEEP).alias("name"), "pos", F.lit(None).cast("string").alias("first_text"), F.lit(None).cast("string").alias("second_text"))


def test_loop_ends_and_resumes(spark, tmp_path):
    out, stats = refine.refine(state(spark, 12), keep_all, saver(tmp_path), refine.Config(window=6))
    assert stats.finished == [6, 9, 12] and refine.progress(out).first().finished == 12
    assert refine.load_checkpoint(spark, str(tmp_path), "in.srt").count() == 12
    assert refine.load_checkpoint(spark, str(tmp_path), "other.srt") is None
    assert refine.load_checkpoint(spark, str(tmp_path / "none"), "in.srt") is None


def test_silent_service_stops_the_loop(spark, tmp_path):
    silent = lambda entries, retry: keep_all(entries, retry).where("pos < 8")
    with pytest.raises(RuntimeError, match="no progress"):
        refine.refine(state(spark, 12), silent, saver(tmp_path), refine.Config(window=6, max_idle=2))
    saved = refine.load_checkpoint(spark, str(tmp_path), "in.srt")
    assert refine.progress(saved).first().finished == 7


def test_progress_windows_and_texts(spark):
    s = state(spark, 20, done=(1, 2, 3, 5))
    p = refine.progress(s).first()
    assert (p.total, p.finished, p.refined, p.first_unfinished) == (20, 4, 0, 4)
    w = refine.windows(s, 6).first()
    assert (w.win_start, w.win_end, w.context_count, w.unfinished_count) == (1, 6, 3, 2)
    assert refine.windows(state(spark, 2, done=(1, 2)), 6).count() == 0
    text = refine.window_text(s.where("pos < 3").withColumn("win", F.lit(0))).first().prompt
    assert text == "Subtitle #1:\n  Target: a1\n  Source: b1\n\nSubtitle #2:\n  Target: a2\n  Source: b2\n"


def as_asked(entries, retry):
    """Keeps odd positions; changes even ones, a text more with every round, and leaves out 8 unless it is asked first."""
    rows = entries.where("state = 'unfinished' and (pos <> 8 or first_unfinished = 8)")
    name = F.when(F.col("pos") % 2 == 1, refine.KEEP).otherwise(refine.CHANGE)
    text = lambda t: F.when(F.col("pos") % 2 == 0, F.concat(F.lit(t), F.col("pos").cast("string")))
    return rows.select("track", F.col("pos").alias("call_seq"), name.alias("name"), "pos", text("f").alias("first_text"), text("s").alias("second_text"))


def rows_of(state):
    return sorted(map(tuple, state.select("track", "pos", "state", "text").collect()))


def test_logged_refinement_is_refinement(spark, tmp_path):
    want, plain = refine.refine(state(spark, 20, done=(3,)), as_asked, saver(tmp_path / "plain"), refine.Config(window=6))
    log = CallLog(spark, str(tmp_path / "log"), "dir/in ü.srt")
    got, stats = refine.refine_logged(state(spark, 20, done=(3,)), as_asked, log, refine.Config(window=6, checkpoint_every=2))
    assert rows_of(got) == rows_of(want) and stats.finished == plain.finished
    assert log.remove() and not log.begun()


def test_a_round_writes_its_calls_and_bases_end_the_log(spark, tmp_path):
    log = CallLog(spark, str(tmp_path), "in.srt")
    log.begin(state(spark, 2000))
    for n, (low, high) in enumerate(((1, 6), (7, 9)), 1):
        log.append(keep_all(log.state().where(f"pos between {low} and {high}"), False))
        assert log.last() == n
    assert [log.spark.read.parquet(log._at("calls", n)).count() for n in (1, 2)] == [6, 3]
    assert log.calls(0).count() == 9 and log.calls(1).count() == 3 and log.calls(2) is None
    before = rows_of(log.state())
    log.compact()
    assert rows_of(log.state()) == before and log._rounds("base") == [2] and log._rounds("calls") == [] and log.last() == 2
    log.append(keep_all(log.state().where("pos = 10"), False))
    assert log.last() == 3 and refine.progress(log.state()).first().finished == 10


def test_later_rounds_change_what_earlier_ones_set(spark, tmp_path):
    log = CallLog(spark, str(tmp_path), "in.srt")
    log.begin(state(spark, 3))
    for f, seq in (("late", 9), ("later", 1)):
        log.append(spark.createDataFrame([("t", seq, refine.CHANGE, 2, f, "s")], CALLS))
    assert rows_of(log.state())[1] == ("t", 2, "finished", "s\nlater")


def test_a_lost_run_goes_on_from_its_log(spark, tmp_path):
    log, asked = CallLog(spark, str(tmp_path), "in.srt"), []

    def breaks(entries, retry):
        asked.append(entries.agg(F.min("pos")).first()[0])
        if len(asked) == 4:
            raise RuntimeError("lost")
        return as_asked(entries, retry)

    config = refine.Config(window=4, checkpoint_every=2)
    with pytest.raises(RuntimeError, match="lost"):
        refine.refine_logged(state(spark, 20), breaks, log, config)
    # a round and a base that were under way
    for name in ("calls-00000004", "base-00000003"):
        (tmp_path / "in.srt" / name).mkdir()
    reached = refine.progress(log.state()).first().finished
    assert log.last() == 3 and reached > 0
    got, stats = refine.refine_logged(None, breaks, log, config)
    assert stats.finished[0] > reached
    assert rows_of(got) == rows_of(refine.refine(state(spark, 20), as_asked, saver(tmp_path / "plain"), config)[0])
    with pytest.raises(ValueError):
        refine.refine_logged(None, breaks, CallLog(spark, str(tmp_path), "other.srt"), config)


def test_logged_refinement_without_progress_ends(spark, tmp_path):
    with pytest.raises(RuntimeError, match="no progress in 2 rounds: 0 of 5"):
        refine.refine_logged(state(spark, 5), lambda e, retry: keep_all(e, retry).where("false"), CallLog(spark, str(tmp_path), "x"), refine.Config(max_idle=2))
