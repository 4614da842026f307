"""The pipeline against a version in plain Python that shares no code with the operators."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

import corpus_pipeline
from test_dups import brute_leaks
from test_line_mix_warc import brute_lines
from test_near_text import components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    """Features in the order of the rules' tests, and whether the base rules reject the text."""
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    n, chars, n_lines = max(len(w), 1), max(sum(map(len, w)), 1), max(len(lines), 1)
    x = (len(w), sum(map(len, w)) / n, len(re.findall(r"[#*$%&|<>]", t)) / n, (len(lines) - len(set(lines))) / n_lines, len(inside) / n, len(regex.findall(r"\p{Lu}", t)) / chars, t.count("!") / n, len(set(w)) / n, len(w) / n_lines)
    return tuple(map(float, x)), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def covers(rule, x):
    return all(x[j] > t if above else x[j] <= t for j, above, t in rule)


def best_test(rows):
    """The test of the largest information gain, by trying them all."""
    p0, n0 = sum(b for _, b in rows), sum(not b for _, b in rows)
    best = (0.0, None)
    if not p0 or not n0:
        return None
    for j in range(9):
        values = sorted({x[j] for x, _ in rows})
        for above in (False, True):
            here = (0.0, None)
            for a, b in zip(values, values[1:]):
                rule = (j, above, (a + b) / 2)
                hit = [bad for x, bad in rows if covers([rule], x)]
                p = sum(hit)
                gain = p * (math.log2(p / len(hit)) - math.log2(p0 / (p0 + n0))) if p else 0
                if gain > here[0] + 1e-12:
                    here = (gain, rule)
            if here[0] > best[0] + 1e-9:
                best = here
    return best[1]


def learn(rows):
    """Sequential covering: rules grow on two thirds of the rows, are pruned on the rest, and cover 0.9 bad rows or more."""
    out, left = [], list(enumerate(rows))
    while len(out) < 16 and sum(b for _, (_, b) in left) >= 3:
        grow, prune = [r for k, r in left if k % 3 != 2], [r for k, r in left if k % 3 == 2]
        rule, rest = [], grow
        while len(rule) < 4 and (t := best_test(rest)):
            rule.append(t)
            rest = [r for r in rest if covers([t], r[0])]
        if not rule:
            break

        def worth(r):
            hit = [b for x, b in prune if covers(r, x)]
            return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

        grown = rule
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        for r in (rule, grown):
            hit = [b for _, (x, b) in left if covers(r, x)]
            if sum(hit) >= 3 and sum(hit) >= 0.9 * len(hit):
                out.append(r)
                left = [(k, v) for k, v in left if not covers(r, v[0])]
                break
        else:
            break
    return out


def quality(rows, labels):
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    seen = sorted((i, q, *counts(r["text"])[0]) for i, q in labels if i is not None and q is not None for r in by_id[i] if not counts(r["text"])[1])
    rules = learn([(x[2:], x[1] == 0) for x in seen])
    return [r for r in rows if not counts(r["text"])[1] and not any(covers(rule, counts(r["text"])[0]) for rule in rules)]


def lines(rows):
    got = brute_lines([(r["doc_id"], r["text"]) for r in rows])
    by = {}
    for i, n, dropped, kept in got:
        by.setdefault((i, n), []).append((dropped, kept))
    out = []
    for r in rows:
        (dropped, kept), = [x for x in by[(r["doc_id"], len((r["text"] or "").split("\n")))]]
        out.append(r | {"text": kept, "n_chars": len(kept)} if dropped else r)
    return out


def near(rows):
    roots = components([(r["doc_id"], r["text"]) for r in rows])
    least = {}
    for r, c in zip(rows, roots):
        if r["doc_id"] is not None:
            least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    out, seen = [], set()
    for r, c in zip(rows, roots):
        i = r["doc_id"]
        if (least.get(c) is None) or (i == least[c] and i not in seen):
            out.append(r)
            seen.add(i)
    return out


def clean(rows, items):
    leaky = {d for d, _ in brute_leaks([(r["doc_id"], r["text"]) for r in rows], items)}
    return [r for r in rows if r["doc_id"] not in leaky]


def mixed(rows):
    chars = Counter()
    for r in rows:
        chars[r["source"]] += len(r["text"] or "")
    sources = sum(1 for c in chars.values() if c)
    out = Counter()
    for r in rows:
        rate = sum(chars.values()) / sources / chars[r["source"]] if chars[r["source"]] else 1.0
        ident = "null" if r["doc_id"] is None else r["doc_id"]
        u, total, n = int(hashlib.md5(f"20:{ident}".encode()).hexdigest()[:13], 16) / 2**52, 0.0, 0
        while n < 10_000:
            total += math.exp(-rate + n * math.log(rate) - math.lgamma(n + 1))
            if total > u:
                break
            n += 1
        for k in range(n):
            out[tuple(r[c] for c in COLUMNS) + (n, k)] += 1
    return out


def tables(spark, sf_dir, tmp_path):
    """The supplied tables with planted rows: copies, near copies, passages of the benchmark, nulls, repeated rows."""
    docs, labels, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    rows = [r.asDict() for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    good = [r for r in rows if not counts(r["text"])[1]][:40]
    add = lambda i, t, source="planted": rows.append({"doc_id": i, "text": t, "lang": "en", "source": source, "n_chars": len(t or "")})
    for k, r in enumerate(good[:10]):
        add(10_000 + k, r["text"].upper() if k % 2 else r["text"])
        w = r["text"].split(" ")
        w[len(w) // 2] = "changed"
        add(10_100 + k, " ".join(w))
        add(10_200 + k, f"{good[20 + k]['text']} {items[k % len(items)][1]} tail")
    add(11_000, None)
    add(11_001, "")
    add(11_002, "word " * 60, None)
    add(None, good[30]["text"][::-1])
    add(11_003, good[31]["text"][::-1])
    rows.append(dict(rows[-1]))
    for name, df in (("documents", spark.createDataFrame(rows, docs.schema)), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return rows, [(r.doc_id, r.quality) for r in labels.collect()], items


def test_pipeline_equals_brute_force(spark, sf_dir, tmp_path):
    rows, labels, items = tables(spark, sf_dir, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = [lambda r: quality(r, labels), lines, near, lambda r: clean(r, items)]
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps):
        before, rows = rows, step(rows)
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"test_{name}")
        assert docs.columns == COLUMNS
        assert Counter(map(tuple, docs.collect())) == Counter(tuple(r[c] for c in COLUMNS) for r in rows), name
        assert rows != before, name
    want = mixed(rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).select(*COLUMNS, "n_copies", "copy").collect()
    assert Counter(map(tuple, got)) == want and 0 < len(got)


def test_clashing_columns_and_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.withColumns({n: F.lit("mine") for n in ("all", "s", "h", "at", "of", "row_id", "node", "kept", "rate")})
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, sf_dir).columns == COLUMNS, name
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
