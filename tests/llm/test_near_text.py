import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cuelake.llm import near_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n)]


def grams(t):
    w = WORD.findall((t or "").translate(LOW))
    return Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))


def components(rows):
    """Brute force: a number for the component of each text, over all pairs at 0.8 or more."""
    g, root = [grams(t) for _, t in rows], list(range(len(rows)))
    sizes = [sum(x.values()) for x in g]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if min(sizes[i], sizes[j]) < 0.8 * max(sizes[i], sizes[j]):
                continue
            inter = sum((g[i] & g[j]).values())
            both = sizes[i] + sizes[j]
            if not both or inter * 9 >= both * 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def kept(rows):
    """The least doc_id of each component."""
    least = {}
    for c, (i, _) in zip(components(rows), rows):
        least[c] = min(i, least.get(c, i))
    return sorted(least.values())


def edited(r, w, share):
    """w with about this share of its shingles changed: a word in another place spoils up to five."""
    w = list(w)
    for at in r.sample(range(len(w)), int(share * len(w) / 5)):
        w[at] = words(r, 1)[0]
    return w


def rows_of(seed, n=160):
    r = random.Random(seed)
    base = [words(r, r.choice((60, 100, 400))) for _ in range(25)]
    rows = [(i, " ".join(edited(r, r.choice(base), r.choice((0, 0.03, 0.06, 0.1, 0.15, 0.2))))) for i in range(n)]
    short = ["", None, " \t", "one Two", "ONE two", "a b c d e", "a b a b a b a b a b a b", "a b a b a b a b a b"]
    return rows + [(n + k, t) for k, t in enumerate(short)]


@pytest.mark.parametrize("block", [600, 1 << 21])
def test_stage_equals_brute_force(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(near_text, "BLOCK_SHINGLES", block)
    r = random.Random(block)
    # a group of near copies about the threshold, and texts that share a passage and thus bands, but not the similarity
    base, passage = words(r, 90), words(r, 60)
    rows = [(1000 + k, " ".join(edited(r, base, 0.12))) for k in range(60)] + [(2000 + k, " ".join(passage + words(r, 40))) for k in range(60)] + rows_of(block, 80)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, df, sf_dir).collect())
    assert got == kept(rows) and len(got) < len(rows) - 30


def test_bands_find_pairs_at_the_threshold():
    r = np.random.default_rng(3)
    for _ in range(300):
        x = r.integers(0, 1 << 63, 1000, np.uint64)
        a, b = x[:900], x[100:]  # 800 of 1,000 shared
        assert (near_text.bands(a) == near_text.bands(b)).any()
