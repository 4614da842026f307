import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cuelake.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc, more=0):
    i, text, lang, source, n = doc
    return h(*map(field, (i, source, lang, None if n is None else n + more, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append([h(*x[k : k + 2]) for k in range(0, len(x), 2)])
    return out


def siblings(tree, at):
    """(sibling or None, whether it is on the left) per level."""
    return [(level[(at >> k) ^ 1] if (at >> k) ^ 1 < len(level) else None, at >> k & 1) for k, level in enumerate(tree[:-1])]


def brute(docs):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) by whole trees."""
    langs = {}
    for d in docs:
        langs.setdefault(d[2], []).append(d)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        langs[lang].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees.append(levels([leaf(d) for d in langs[lang]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, lang in enumerate(order):
        for at, d in enumerate(langs[lang]):
            path = siblings(trees[k], at) + siblings(top, k)
            wrong = d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            now = leaf(d, int(wrong))
            for other, left in path:
                now = h(other or "", now) if left else h(now, other or "")
            out.append((d[0], leaf(d), trees[k][-1][0], top[-1][0], h(*[x for x, _ in path if x]), now, now == top[-1][0]))
    return sorted(out, key=repr)


def got(spark, docs, height=merkle.HEIGHT, schema=SCHEMA):
    m = merkle.manifest(spark.createDataFrame(docs, schema), merkle.with_more_chars(), height)
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.substring(x, 2, 64)), ""), 256)
    rows = m.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", F.expr("folded_root = root")).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def some(n, lang):
    return [(i * 7 + len(lang or ""), f"text {i} é\n" * (i % 4), lang, None if i % 5 == 0 else f"s{i % 3}", None if i % 11 == 0 else i) for i in range(n)]


@pytest.mark.parametrize("height", [1, 3, 10])
def test_manifest_against_whole_trees(spark, height):
    docs = some(37, "en") + some(16, "fr") + some(1, "de") + some(9, None) + some(2, "zz")
    assert got(spark, docs, height) == brute(docs)


def test_many_languages_are_a_tree_too(spark):
    docs = [d for k in range(21) for d in some(1 + k % 3, f"l{k:02d}")]
    assert got(spark, docs, 2) == brute(docs)


def test_one_document_none_and_repeats(spark):
    assert got(spark, []) == []
    one = some(1, "en")
    assert got(spark, one) == brute(one)
    docs = [(None, None, None, None, None), (None, "", "", "", 0), (3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (3, "b", "en", "s", 1), (9, "long " * 50_000, "en", "s", 2**63 - 1)]
    assert got(spark, docs, 1) == brute(docs)


def test_other_columns_do_not_clash(spark):
    docs = some(5, "en")
    more = got(spark, [(*d, "x", 1) for d in docs], schema=SCHEMA + ", tree string, pos bigint")
    assert more == brute(docs)


def test_traversal_holds_a_logarithmic_number_of_nodes():
    n, held = 10, 0
    leaves = [h(str(i)) for i in range((1 << n) - 5)]
    made = []

    class Counted(merkle.Treehash):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)

    real, merkle.Treehash = merkle.Treehash, Counted
    try:
        for at, path in enumerate(merkle.traverse(leaves, n)):
            live = {s.height: s for s in made}  # the last of each height is in use
            held = max(held, sum(len(s.stack) for s in live.values()))
            assert len(path) == n
            if at % 97 == 0:
                assert merkle.fold(leaves[at], merkle._steps(at, path)) == merkle.root_of(leaves, n)
    finally:
        merkle.Treehash = real
    assert held <= 3 * n
