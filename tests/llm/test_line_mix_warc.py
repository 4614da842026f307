import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from compare import assert_same, views
from cuelake.llm import line_dedup, mixing, registry, warc
from cuelake.llm.common import shared_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "This Line is long enough to count as a common line, ok"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", ["op1_warc", "op2_suffix_dedup", "op6_line_dedup", "op7_mix_sources"])
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], views(sf_dir))


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        lost = [i is not None and len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and i < max(holders[key(x)]) for x in lines]
        out.append((i, len(lines), sum(lost), "\n".join(x for x, gone in zip(lines, lost) if not gone)))
    return Counter(out)


def test_lines_against_brute_force(spark):
    rows = [(i, f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\n{LONG}\nend") for i in range(8)]
    rows += [(3, LONG), (3, LONG), (100, None), (101, ""), (None, LONG), (102, "É" * 45 + "\n" + LONG * 300), (103, "x\n" * 500 + LONG), (7, LONG)]
    got = line_dedup.line_dedup(docs_of(spark, rows).withColumns({"runs": F.lit("mine"), "of": F.lit(1), "row_h": F.lit(2)}))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == brute_lines(rows)
    assert {"of", "row_h", "runs", "source"} <= set(got.columns)
    for r in got.collect():
        assert sum(x.last - x.first + 1 for x in r.runs) == r.n_dropped
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0


def test_rare_and_short_lines_stay(spark):
    rows = [(i, LONG if i < 4 else "short") for i in range(20)]
    assert all(r.n_dropped == 0 for r in line_dedup.line_dedup(docs_of(spark, rows)).collect())


def test_mixing_draws_poisson_copies(spark):
    rows = [(i, "x" * 10, "en", "big" if i % 3 else "small", 10) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(df)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 1500) < 150 and abs(n["small"] - 1500) < 150
    again = sorted((r.doc_id, r.copy) for r in mixing.mix_sources(df.repartition(7)).collect())
    assert again == sorted((r.doc_id, r.copy) for r in out.collect())
    copies = Counter(r.doc_id for r in out.where("source = 'small'").collect())
    share = sum(1 for i in range(0, 3000, 3) if copies[i] == 0) / 1000
    assert abs(share - math.exp(-1.5)) < 0.04
    one = mixing.mix_sources(df, {"small": 1.0}, epochs=0.5)
    assert {r.source for r in one.collect()} == {"small"}


def test_many_sources_give_the_same(spark, monkeypatch):
    rows = [(i, "x" * (i % 90) if i else "long " * 100_000, "en", f"s{i % 40}" if i % 7 else None, 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    take = lambda: sorted((r.doc_id, r.copy, r.mix_key) for r in mixing.mix_sources(df).select("doc_id", "copy", "mix_key").collect())
    want = take()
    monkeypatch.setattr(mixing, "RATES_BROADCAST", 5)
    assert take() == want and len(want) > 100


def test_mixing_edges(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "abc", "en", None, 3), (2, "abc", "en", None, 3)]
    df = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit("mine")).withColumn("of", F.lit("x"))
    out = mixing.mix_sources(df)
    assert out.columns.count("copy") == 1 and "of" in out.columns
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing._poisson_cdf(0.0)[1].tolist() == [1.0] and abs(mixing._poisson_cdf(900.0)[1][-1] - 1) < 1e-9
    low, cdf = mixing._poisson_cdf(1e8)
    assert len(cdf) < 300_000 and abs(cdf[-1] - 1) < 1e-6 and cdf[0] < 1e-20


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_reads_back(spark):
    big, small = "é" * 600, "tiny"
    rows = [(8, "a%0A\nb%", "x\r\n\r\ny" * 400_000), (9, "", "\r\n\r\n"), (1, "http://a/\r\nX: y", big), (5, "u", big), (3, None, big), (2, "u", small), (4, "u", small), (6, "u", None), (7, "u", ""), (5, "u", big), (None, "u", big)]
    path = warc.write_archive(pages_of(spark, rows).withColumn("sha256", F.lit("mine")), shared_path(spark, "t"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.scan_archive(spark, path).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter()
    for i, _, t in rows:
        revisit = t == big and i != 5
        want[(i, len((t or "").encode()), sha(t), "revisit" if revisit else "response", 5 if revisit else None)] += 1
    assert got == want
    assert Counter((r.page_id, r.url) for r in warc.scan_archive(spark, path).collect()) == Counter((i, u) for i, u, _ in rows)
    assert warc.read_payloads(spark, path).count() == 5
    records = warc.reconstruct(spark, path).collect()
    assert Counter(bytes(r.payload).decode() for r in records) == Counter(t or "" for _, _, t in rows)
    raw = [bytes(r.record) for r in records]
    assert len(raw) == len(rows)
    for r in raw:
        head, _, block = r.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert r.startswith(b"WARC/1.1\r\n") and block[size:] == b"\r\n\r\n"
        if b"WARC-Type: response" in head:
            body = block[:size].partition(b"\r\n\r\n")[2]
            assert hashlib.sha1(body).hexdigest().encode() in head
    assert sum(b"Revisit" in r or b"WARC-Type: revisit" in r for r in raw) == 3


def test_headers_that_name_another_payload_are_noticed(spark):
    path = warc.write_archive(pages_of(spark, [(1, "u", "x"), (2, "u", "y")]), shared_path(spark, "t"))
    for old, new, error in (("sha1:", "sha1:0", "don't name"), ("application/http; msgtype=response\r\nContent-Length: ", "application/http\r\nContent-Length: 1", "not as long")):
        other = shared_path(spark, "t")
        r = warc.read_records(spark, path)
        r.withColumn("headers", F.encode(F.replace(F.decode("headers", "UTF-8"), F.lit(old), F.lit(new)), "UTF-8")).write.parquet(f"{other}/records")
        warc.read_payloads(spark, path).write.parquet(f"{other}/payloads")
        with pytest.raises(Exception, match=error):
            warc.scan_archive(spark, other).collect()


def test_damaged_payload_is_noticed(spark):
    path = warc.write_archive(pages_of(spark, [(1, "u", "x")]), shared_path(spark, "t"))
    spark.createDataFrame([("00", bytearray(b"y"))], "sha256 string, payload binary").write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_payloads(spark, path).collect()
    empty = warc.write_archive(pages_of(spark, []), shared_path(spark, "t"))
    assert warc.scan_archive(spark, empty).count() == 0 and warc.reconstruct(spark, empty).count() == 0
