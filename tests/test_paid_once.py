import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelake.operators.paid_once import TokenBucket, _cut, call_once


def service(path, breaks_after=None, fails_on="", well=True):
    """Upper-cases; every request that it gets is a line of a file. It may break down after some, or fail on a text."""

    class Logged:  # made here, as workers can't import this module
        def healthy(self):
            return well

        def call(self, requests):
            if breaks_after is not None and os.path.exists(path):
                with open(path) as f:
                    if len(f.readlines()) >= breaks_after:
                        raise RuntimeError("out of service")
            with open(path, "a") as f:
                f.writelines(f"{r['k']}\n" for r in requests)
            return [None if r["k"] == fails_on else {"answer": (r["k"] or "none").upper(), "size": len(r["k"] or "")} for r in requests]

    path = str(path)
    return Logged()


def asked(path):
    with open(path) as f:
        return f.read().split("\n")[:-1]


def rows(spark, n=200):
    return spark.range(n).select("id", F.concat(F.lit("w"), (F.col("id") % 70).cast("string")).alias("k"))


def ask(df, provider, store, **options):
    return call_once(df, provider, "test", ["k"], "answer string, size long", str(store), **options)


def test_equal_requests_are_one_call_and_a_second_run_calls_nothing(spark, tmp_path):
    log = tmp_path / "log"
    df = rows(spark).unionByName(spark.createDataFrame([(900, None), (901, "none"), (902, None)], "id long, k string"))
    for _ in range(2):
        got = {r.id: (r.answer, r["size"]) for r in ask(df, service(log), tmp_path / "store", batch=8).collect()}
        assert got[5] == got[75] == ("W5", 2) and got[900] == got[902] == ("NONE", 0) and got[901] == ("NONE", 4) and len(got) == 203
        assert sorted(asked(log)) == sorted([*(f"w{k}" for k in range(70)), "None", "none"])


def test_a_run_that_broke_down_pays_only_for_what_is_missing(spark, tmp_path):
    log, store = tmp_path / "log", tmp_path / "store"
    with pytest.raises(Exception, match="out of service"):
        ask(rows(spark), service(log, breaks_after=30), store, batch=5, calls_at_once=2).collect()
    before = asked(log)
    assert 30 <= len(before) < 70
    # a task that was killed while it wrote
    (store / "_draft").write_bytes(b"PAR1 half")
    got = ask(rows(spark), service(log), store, batch=7, calls_at_once=3).collect()
    assert all(r.answer == r.k.upper() for r in got) and len(got) == 200
    assert sorted(asked(log)) == sorted({f"w{k}" for k in range(70)})


def test_failed_requests_are_null_and_asked_again(spark, tmp_path):
    log, store = tmp_path / "log", tmp_path / "store"
    got = {r.k: r.answer for r in ask(rows(spark, 10), service(log, fails_on="w3"), store, retries=1).collect()}
    assert got["w3"] is None and got["w4"] == "W4" and asked(log).count("w3") == 2 and asked(log).count("w4") == 1
    assert {r.k: r.answer for r in ask(rows(spark, 10), service(log), store).collect()}["w3"] == "W3" and asked(log).count("w4") == 1


def test_services_and_empty_tables(spark, tmp_path):
    log = tmp_path / "log"
    assert ask(rows(spark, 0), service(log), tmp_path / "store").count() == 0 and not log.exists()
    for name in ("a", "b"):
        call_once(rows(spark, 3), service(log), name, ["k"], "answer string", str(tmp_path / "store")).collect()
    assert len(asked(log)) == 6

    with pytest.raises(Exception, match="not healthy"):
        ask(rows(spark, 5), service(log, well=False), tmp_path / "new").collect()


def test_a_bucket_waits_for_what_it_lacks():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(round(s, 6))
        now[0] += s

    b = TokenBucket(10, 20, lambda: now[0], sleep)
    for n in (20, 5, 5, 50):
        b.take(n)
    assert waits == [0.5, 0.5, 5.0]
    now[0] += 100
    b.take(20)
    assert len(waits) == 3
    with pytest.raises(ValueError):
        TokenBucket(0, 1)


def test_batches_are_the_same_whatever_comes_at_once():
    df = pd.DataFrame({"a": range(23)})
    for size in (1, 4, 23):
        assert [p["a"].tolist() for p in _cut((df[i : i + size] for i in range(0, 23, size)), 7)] == [[*range(0, 7)], [*range(7, 14)], [*range(14, 21)], [21, 22]]
