import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuelake.llm import common, components, decontam, simhash_dedup, suffix_dedup

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


# --- repeated substrings


def brute_spans(rows, n=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in raw:
        if i is not None:
            for p in range(len(t) - n + 1):
                first[t[p : p + n]] = min(i, first.get(t[p : p + n], i))
    out = Counter()
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        if i is not None:
            for p in range(len(t) - n + 1):
                if first[t[p : p + n]] < i:
                    gone[p : p + n] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[(i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("chunk", "bucket", "ranges"), [(1 << 11, 1 << 23, 1 << 16), (1 << 10, 1 << 8, 1 << 16), (1 << 10, 1 << 9, 7), (1 << 20, 1 << 9, 1 << 16)])
def test_spans_against_brute_force(spark, chunk, bucket, ranges):
    r = random.Random(chunk)
    common = [words(r, 30) for _ in range(4)]
    rows = [(i, " ".join(r.sample([words(r, r.randint(0, 60)), r.choice(common), r.choice(common)[: r.randint(20, 120)], "é" * r.randint(0, 40)], 4))) for i in range(40)]
    rows += [(50, rows[7][1]), (51, rows[7][1]), (52, "of of " * 60), (53, "of of " * 70 + "x"), (54, "\0" * 70), (55, "\0" * 60), (56, None), (57, ""), (58, "x" * 49), (59, "x" * 49), (60, "y" * 50), (61, "y" * 50)]
    rows += [(None, rows[7][1]), (7, rows[9][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, DOCS).withColumn("chunk", F.lit("mine"))
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.repeated_spans(df, chunk_bytes=chunk, bucket_bytes=bucket, max_ranges=ranges).collect())
    assert got == brute_spans(rows)


def test_spans_of_a_long_text_and_an_empty_table(spark):
    r = random.Random(2)
    t = words(r, 90_000)
    rows = [(1, t), (2, t[100_000:100_060] + "\n" + t[-200:])]
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.repeated_spans(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute_spans(rows)
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(spark.createDataFrame([], DOCS), length=100)


def test_one_anchor_over_many_buckets(spark, monkeypatch):
    # every document holds the same passage, so most suffixes share few anchors: their runs go on across boundaries
    r = random.Random(5)
    passage = words(r, 12)
    rows = [(i, words(r, 3) + " " + passage + " " + words(r, 3)) for i in range(1, 121)]
    sent = []
    monkeypatch.setattr(suffix_dedup, "_across", lambda a, f=suffix_dedup._across: sent.append(a.where("kind = 2").count()) or f(a))
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.repeated_spans(spark.createDataFrame(rows, DOCS), chunk_bytes=600, bucket_bytes=300).collect())
    assert got == brute_spans(rows)
    assert sum(sent) > 100


def test_multikey_order():
    r = np.random.default_rng(1)
    w = r.integers(0, 3, (500, 4)).astype(np.uint64)
    order, group = suffix_dedup.multikey_order(w)
    got = [tuple(x) for x in w[order].tolist()]
    assert got == sorted(got)
    assert [got[k] == got[k + 1] for k in range(499)] == (group[1:] == group[:-1]).tolist()


# --- SimHash


def brute_print(t):
    w = WORD.findall((t or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def near_rows(r):
    base = [words(r, 200) for _ in range(6)]
    rows = []
    for i in range(60):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = words(r, 1)
        rows.append((i, " ".join(w)))
    return rows + [(60, None), (61, ""), (62, " \t"), (63, "one Two"), (64, "ONE two"), (65, rows[3][1]), (3, "again"), (None, rows[5][1]), (66, words(r, 60_000))]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows(random.Random(5))
    df = spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit("mine"), "root": F.lit("x")})
    prints = [brute_print(t) for _, t in rows]
    classes = brute_components(prints)
    least = {}
    for (i, _), c in zip(rows, classes):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = Counter((i, p, least[c]) for (i, _), p, c in zip(rows, prints, classes))
    got = Counter((x.doc_id, x.fp % (1 << 64), x.component_id) for x in simhash_dedup.near_duplicates(df).collect())
    assert got == want
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(x.doc_id for x in kept) == sorted({v for v in least.values() if v is not None})


def test_large_buckets_lose_no_link(spark):
    r = random.Random(6)
    prints = {r.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for _ in range(20):
            q = p
            for b in r.sample(range(64), r.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    prints = sorted(prints)
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    classes = brute_components(prints)
    for limit in (3, 5000):
        links = simhash_dedup.near_links(fps, max_bucket=limit)
        assert all(((x.a ^ x.b) % (1 << 64)).bit_count() <= 4 for x in links.collect())
        roots = {x.node % (1 << 64): x.root for x in components.components(links).collect()}
        groups = {}
        for p, c in zip(prints, classes):
            groups.setdefault(c, set()).add(roots.get(p, p))
        assert all(len(g) == 1 for g in groups.values()) and len({g.pop() for g in groups.values()}) == len(set(classes))


def test_covering_masks_cover_every_small_difference():
    masks = simhash_dedup.covering_masks(list(range(64)), 4)
    r = random.Random(1)
    assert len(masks) == 31
    for _ in range(3000):
        d = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not m & d for m in masks)


def test_components_of_a_path_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination


def brute_leaks(rows, items):
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    out = {}
    for d, t in rows:
        for i, x in items:
            w = WORD.findall((x or "").translate(LOW))
            k = min(5, len(w))
            g, want = grams(WORD.findall((t or "").translate(LOW)), k), Counter(grams(w, k))
            m = sum(want.values()) if k else 0
            if not want.keys() & set(g):
                continue
            for s in range(1 - m, len(g) if m else 0):
                a = Counter(g[max(0, s) : s + m])
                inter = sum((a & want).values())
                v = inter / (sum(a.values()) + m - inter)
                if v >= 0.8:
                    out[(d, i)] = max(v, out.get((d, i), 0))
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    items = [(k, words(r, r.randint(12, 40))) for k in range(10)] + [(10, "too short"), (11, None), (12, ""), (13, "a b a b a b a b a b a b a b"), (0, words(r, 15)), (14, "One"), (15, "so it ENDS here"), (16, "b a b")]
    rows = []
    for d in range(60):
        t = items[r.randrange(10)][1].split()
        kind = d % 6
        if kind == 1:
            t[r.randrange(len(t))] = "changed"
        elif kind == 2:
            t = t[: len(t) // 2]
        elif kind == 3:
            t = [w.upper() for w in t[1:]]
        elif kind == 4:
            t = []
        elif kind == 5:
            t[-1] += "###"
        rows.append((d, f"{words(r, r.choice((0, 30)))}\n{' '.join(t)}\t{words(r, r.choice((0, 30)))}"))
    rows += [(100, None), (101, ""), (102, "b a b a b a b a b a b a b a b"), (5, rows[0][1]), (None, rows[0][1]), (103, f"{words(r, 5000)} {items[3][1]} {words(r, 5000)}"), (104, "and so it ends here"), (105, "one"), (106, "too short"), (107, f"x {items[4][1]} " * 30)]
    df, bench = spark.createDataFrame(rows, DOCS).withColumns({"at": F.lit(1), "h": F.lit("x"), "of": F.lit("y")}), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items)
    got = {(x.doc_id, x.item_id): x.similarity for x in decontam.find_leaks(df, bench).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = [x.doc_id for x in decontam.decontaminate(df, bench).collect()]
    leaky = {d for d, _ in want}
    assert Counter(left) == Counter(d for d, _ in rows if d not in leaky)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(df, none).count() == 0 and decontam.decontaminate(df, none).count() == len(rows)
    assert decontam.find_leaks(spark.createDataFrame([], DOCS), bench).count() == 0


def test_shuffled_sides_give_the_same(spark, monkeypatch):
    r = random.Random(9)
    items = [(k, words(r, 20)) for k in range(3)]
    rows = [(d, f"{words(r, 10)} {items[d % 3][1]}") for d in range(6)]
    df, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontam.find_leaks(df, bench).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, decontam.find_leaks(df, bench).collect())) == want
    plan = decontam.find_leaks(df, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_pairs_near_the_threshold_are_found(spark):
    """Passages edited to a similarity from 0.8 to 0.85: the share that the blocks at this radius let escape is small."""
    r = random.Random(11)
    items = [(k, words(r, 60)) for k in range(150)]
    rows = []
    for k, x in items:
        w = x.split()
        for at in r.sample(range(len(w)), 1) + [0]:
            w[at] = "changed"
        rows.append((k, f"{words(r, 40)} {' '.join(w)} {words(r, 40)}"))
    want = {k: v for k, v in brute_leaks_of_pairs(rows, items).items() if v < 0.87}
    got = {x.doc_id for x in decontam.find_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 100 and len(set(want) & got) >= 0.99 * len(want), (len(want), len(set(want) & got))


def brute_leaks_of_pairs(rows, items):
    return {d: v for (d, t), item in zip(rows, items) for (_, _), v in brute_leaks([(d, t)], [item]).items()}


def test_multisets(spark):
    rows = [([1, 1, 2, 1, 5],), ([],), ([7],), ([3] * 3000,)]
    df = spark.createDataFrame(rows, "h array<long>").select("h", decontam._multiset(F.col("h")).alias("m"))
    for x in df.collect():
        assert len(x.m) == len(set(x.m)) == len(x.h)
    both = spark.createDataFrame([([1, 1, 2, 9], [1, 1, 1, 9, 9])], "a array<long>, b array<long>").select(F.size(F.array_intersect(decontam._multiset(F.col("a")), decontam._multiset(F.col("b")))).alias("n"))
    assert both.first().n == 3


def test_fingerprints_of_windows(spark):
    r = random.Random(12)
    rows = [([r.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (1, 2, 3, 40, 126, 127, 128, 129, 256, 3000)] + [([-1] * 127,), ([-1] * 128,), ([-1] * 300,), ([],)]
    df = spark.createDataFrame(rows, "h array<long>").select("h", decontam.simhash(F.col("h")).alias("f"))
    for x in df.collect():
        assert x.f % (1 << 64) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in x.h) * 2 > len(x.h))
