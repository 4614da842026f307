"""Queries of operators that SQL can't state, on the supplied tables, against plain versions."""

import math
import re
import zlib
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from cuelake.llm import registry, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Article(HTMLParser):
    """The text inside <article>, a line per block."""

    BLOCKS = {"article", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "div", "table", "tr", "td", "th", "blockquote", "pre", "section", "figure", "figcaption", "hr", "footer", "nav", "aside", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.lines = False, [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if self.inside and text:
            self.lines.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_every_page_gives_its_article(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = registry.queries()["op4_html_extract"](spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        a = Article()
        a.feed(pages[r.page_id].html or "")
        a.close()
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, "\n".join(a.lines), len(r.text)), r.page_id


def plain_score(lexicon, text):
    """The longest pattern at each place from left to right, by trying all patterns there."""
    t, at, found = toxicity.fold(text), 0, 0.0
    weights = dict(zip(lexicon.patterns, lexicon.weights))
    while at < len(t):
        here = max((p for p in weights if t.startswith(p, at)), key=len, default=None)
        found += weights.get(here, 0.0)
        at += len(here) if here else 1
    n = len(t.split())
    z = sum(b * x for b, x in zip(lexicon.curve, (1.0, math.log1p(found), 100 * found / (n + 25))))
    return 1 / (1 + math.exp(-z))


def test_toxicity_scores_are_those_of_a_plain_matcher(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = registry.queries()["op9_toxicity"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        assert abs(r.score - plain_score(lexicon, text[r.doc_id])) < 1e-9
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


BAD = bytes([0x61, 0x20, 0xFF, 0xFE, 0x20, 0xC3, 0x28])


@pytest.mark.parametrize("name", ["op1_warc", "op2_suffix_dedup", "op3_simhash_dedup", "op4_html_extract", "op5_decontaminate", "op6_line_dedup", "op7_mix_sources", "op8_quality_rules", "op9_toxicity", "op10_chat_format", "op12_merkle_manifest"])
def test_bytes_that_are_no_utf8_end_no_job(spark, tmp_path, name):
    """A string of any bytes gives a row like any other: Python gets bytes, and takes those that are no UTF-8 as they are or as U+FFFD."""
    bad = F.unhex(F.lit(BAD.hex())).cast("string")
    doc = spark.range(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, F.concat(F.lit("a b c d e "), bad)).otherwise(F.lit("plain words of a text")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    tables = {
        "documents": doc, "labels": doc.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")),
        "pages": doc.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), "text").alias("html")),
        "benchmark": doc.select(F.col("doc_id").alias("item_id"), "text"), "conversations": doc.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text"),
    }
    for n, t in tables.items():
        t.write.parquet(f"{tmp_path}/{n}.parquet")
    rows = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    assert len(rows) >= (1 if name in ("op5_decontaminate", "op7_mix_sources") else 4)
    if name == "op3_simhash_dedup":
        assert sorted(r.component_id for r in rows) == [0, 0, 2, 2]


def test_a_scope_leaves_nothing_but_its_result(spark, sf_dir):
    import corpus_pipeline
    from cuelake.llm import common, suffix_dedup

    shared = Path(common.shared_dir(spark))
    there = lambda: {p.name for p in shared.iterdir() if re.search("-[0-9a-f]{32}$", p.name)}
    before, tables = there(), {t.name for t in spark.catalog.listTables()}
    with common.scope() as outside:
        out = outside(suffix_dedup.op2_suffix_dedup(spark, sf_dir), "result")
    assert [n.partition("-")[0] for n in there() - before] == ["result"] and out.count() > 0
    assert {t.name for t in spark.catalog.listTables()} <= tables
    before = there()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n.partition("-")[0] for n in there() - before] == ["decontamination"]


def plain_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(len(w) - 3, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query_against_all_pairs(spark, sf_dir):
    docs = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in docs:
        for j in docs:
            if i < j and (docs[i] ^ docs[j]).bit_count() <= 4 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = __spark_entry__.queries()["op3_simhash_dedup"](spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, f"{docs[i]:016x}", find(i)) for i in docs)


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n")]
    earlier, n_dup = set(), 0
    for x in lines:
        n_dup += bool(WORD.search(x)) and x in earlier
        earlier.add(x)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {k + d for k in range(len(w) - 2) for d in range(3) if windows[tuple(w[k : k + 3])] > 1}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), n_dup, len(repeated), failed


def test_quality_query_against_plain_counts(spark, sf_dir):
    want = {r.doc_id: plain_counts(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = __spark_entry__.queries()["op8_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert any(r.kept for r in rows)
