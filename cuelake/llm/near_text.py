"""Near-duplicate texts at a similarity: SimHash and covering tables, completed by banded MinHash, checked exactly.

Texts link at a weighted Jaccard similarity of 0.8 or more over shingles of five words. Candidates are the links of
simhash_dedup (covering tables, which miss no pair within the radius), and texts that share one of 20 bands of 3 minimum
hashes. The bands are needed because at similarity 0.8 two SimHash fingerprints differ in 9.7 of 64 bits on average: a
radius that reaches such pairs (18) has 2^19 covering masks, or blocks of 3 or 4 bits, which select nothing among
documents. Bands miss a pair at 0.8 with probability (1 - 0.8^3)^20 = 6e-7, and fewer above it. Every link is
checked by the similarity computed from all shingles of both texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, small, text_key, utf8, written
from .components import components
from .simhash_dedup import RADIUS, keep_least, near_links, simhash

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 20, 3, 42
#: Shingles of a block of texts that are compared with each other in one task, and parts of a cluster that lies in many blocks.
BLOCK_SHINGLES, PARTS = 1 << 21, 8
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes | None) -> np.ndarray:
    """A hash per word, A-Z in lower case."""
    words = (text or b"").lower().split()  # of bytes, lower() and split() know ASCII only
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def node(words: np.ndarray) -> int:
    """Texts of the same words are one node of the graph (64 bits)."""
    return xxhash.xxh64_intdigest(words.tobytes(), SEED)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles, in order. Fewer words are one shingle; none have none."""
    n = len(words)
    if not n:
        return words
    h = np.zeros(max(n - size + 1, 1), np.uint64)
    for k in range(min(size, n)):
        h = _mixed(h + words[k : k + len(h)] + np.uint64(0x9E3779B97F4A7C15))
    return h


def multiset(hashes: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: a hash's n-th copy is an element of its own."""
    found = np.sort(hashes)
    again = np.flatnonzero(found[1:] == found[:-1]) + 1
    if not len(again):
        return found
    copy = again - np.searchsorted(found, found[again])
    found[again] = _mixed(found[again] + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(found)


def bands(elements: np.ndarray) -> np.ndarray:
    """A key per band of minimum hashes; no elements: no keys."""
    if not len(elements):
        return elements
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 2048):  # of a size that stays in the processor's cache
        least = np.minimum(least, np.multiply.outer(_ODD[0], elements[at : at + 2048]).min(1))
    return (least * _ODD[1]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)


_PRINT = T.StructType([T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


@F.pandas_udf(_PRINT)
def _print(texts: pd.Series) -> pd.DataFrame:
    nodes, fps, sizes, keys = [], [], [], []
    for t in texts:
        words = word_hashes(t)
        h = shingles(words)
        nodes.append(node(words))
        fps.append(simhash(h))
        sizes.append(len(h))
        keys.append(bands(multiset(h)).view(np.int64))
    return pd.DataFrame({"node": np.array(nodes, np.uint64).view(np.int64), "fp": np.array(fps, np.uint64).view(np.int64), "n": sizes, "keys": keys})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([multiset(shingles(word_hashes(t))).view(np.int64) for t in texts])


def _candidates(rows: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of buckets (rows: key, node, n, root) the pairs (a, b) to be compared, and what is left (key, node).

    The first node of a bucket meets all others. A bucket with two or more nodes beyond that, in more than one component, is
    left to be compared in another way. Pairs of one component need no comparison, nor do pairs whose sizes alone
    keep them below the similarity. A bucket is never gathered: its first node comes by an aggregate, which both sides of
    the join are shuffled for (the second key sees to that), so that Spark can split a hot bucket.
    """
    heads = rows.groupBy("key").agg(F.min(F.struct("node", "n", "root")).alias("head"), F.count("*").alias("members")).where("members > 1")
    half = lambda c: F.pmod(F.xxhash64(c), F.lit(2))
    heads = heads.select(F.col("key").alias("of"), "head", "members", half("key").alias("of_half"))
    met = rows.withColumn("half", half("key")).join(heads, (F.col("key") == F.col("of")) & (F.col("half") == F.col("of_half"))).where("node <> head.node")
    met = written(met.select("key", "node", "n", "root", "head", "members"), "candidates")
    fits = F.least("n", "head.n") >= similarity * F.greatest("n", "head.n") - 1e-9
    pairs = met.where((F.col("root") != F.col("head.root")) & fits).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()
    more = met.where("members > 2")
    mixed = more.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.col("key").alias("of"), half("key").alias("of_half"))
    rest = more.withColumn("half", half("key")).join(mixed, (F.col("key") == F.col("of")) & (F.col("half") == F.col("of_half")), "left_semi").select("key", "node")
    return pairs, rest


def _sets(docs: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, s: the multiset of shingles of these nodes' texts."""
    need = written(groups.join(nodes, "node", "left_semi").select("node", F.col("text_h").alias("of_h"), F.col("text_n").alias("of_n")), "need")
    # of the texts, only those that are needed leave the JVM; rows alike in text meet in the group
    texts = docs.select("text", *text_key(F.col("text"))).join(small(need, 64 * need.count()), (F.col("text_h") == F.col("of_h")) & (F.col("text_n") == F.col("of_n")))
    return written(texts.groupBy("node").agg(F.first("text").alias("text")).select("node", _shingles(utf8(F.col("text"))).alias("s")), "sets")


def _rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """key, node, n: what a text shares with any text at the similarity, its rarest shingles.

    Of n shingles, at least similarity * n are shared. So two such texts share one among the n - ceil(similarity * n) + 1
    that come first in any one order; in that of rarity, a passage common to many texts comes last.
    """
    tokens = sets.select("node", F.size("s").cast("long").alias("n"), F.explode("s").alias("key"))
    counts = tokens.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    ranked = tokens.join(counts, "key", "left").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(1).cast("long")).alias("held"), "key"))).alias("t"))
    first = F.slice("t", F.lit(1), (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int"))
    return ranked.select("node", "n", F.explode(F.filter(first, lambda t: t["held"] > 1)).alias("t")).select("t.key", "node", "n")


def _alike(docs: DataFrame, groups: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have the similarity, computed from all their shingles."""
    sets = _sets(docs, groups, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = F.size("x") + F.size("y")
    return pairs.join(left, "a").join(right, "b").where(shared * (1 + similarity) >= both * similarity - 1e-9).select("a", "b")


def _within_radius(groups: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes that connect whatever fingerprints within the radius connect."""
    by_fp = written(groups.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = groups.join(by_fp, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    left, right = by_fp.select(F.col("fp").alias("a"), F.col("head").alias("x")), by_fp.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    near = near_links(by_fp.select("fp"), radius).join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.union(near)


def _joined(links: DataFrame) -> DataFrame:
    """was, now: each node of the links and the least node of its component."""
    return written(components(written(links.distinct(), "links")), "joined").select(F.col("node").alias("was"), F.col("root").alias("now"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after new links, which join components found so far."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    links = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = _joined(links.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    moved = roots.join(joined, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    new = joined.join(roots, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return written(moved.union(new), "roots")


def _overlaps(similarity: float):
    """Over the sets (block, node, s) of two blocks, or of one: a spanning set of the links between them.

    Shared shingles are counted through the places of each shingle, one text against all others at once.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "node"], kind="stable")
        nodes, block = pdf["node"].to_numpy(np.int64), pdf["block"].to_numpy(np.int64)
        sizes = np.array([len(x) for x in pdf["s"]], np.int64)
        owner = np.repeat(np.arange(len(nodes)), sizes)
        _, token = np.unique(np.concatenate([np.asarray(x, np.int64) for x in pdf["s"]]), return_inverse=True)
        order = np.argsort(token, kind="stable")
        places, starts = owner[order], np.concatenate(([0], np.cumsum(np.bincount(token))))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        one = block[0] == block[-1]
        out: tuple[list[int], list[int]] = ([], [])
        for x in range(len(nodes) if one else int(np.searchsorted(block, block[-1]))):
            own = token[ends[x] : ends[x + 1]]
            shared = np.bincount(np.concatenate([places[starts[t] : starts[t + 1]] for t in own]), minlength=len(nodes))
            near = np.flatnonzero(shared * (1 + similarity) >= (sizes[x] + sizes) * similarity - 1e-9)
            near = near[near > x] if one else near[block[near] != block[0]]
            out[0].extend([int(nodes[x])] * len(near))
            out[1].extend(nodes[near].tolist())
        # links that join what is joined already say nothing
        least = {}

        def root(v: int) -> int:
            while least.get(v, v) != v:
                least[v] = least.get(least[v], least[v])
                v = least[v]
            return v

        kept = []
        for a, b in zip(*out):
            p, q = root(a), root(b)
            if p != q:
                least[max(p, q)] = min(p, q)
                kept.append((a, b))
        return pd.DataFrame(kept, columns=["a", "b"], dtype=np.int64)

    return run


def _alike_in_blocks(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among the nodes that share a bucket (key, node), without a row per pair.

    Nodes that reach each other over buckets are a cluster, dealt into blocks of a bounded number of shingles. Every two
    blocks of a cluster meet in one task, so a cluster of any size is many tasks of bounded memory.
    """
    heads = rest.groupBy("key").agg(F.min("node").alias("head"))
    edges = rest.join(heads, "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    sized = components(edges).select("node", F.col("root").alias("cluster")).join(sets.select("node", F.size("s").cast("long").alias("size")), "node")
    # borders by running sums over the parts of a cluster, so that no task holds more than a part of its nodes
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS))
    sized = written(sized.withColumn("part", part), "sized")
    before = Window.partitionBy("cluster", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    blocks = sized.select("node", "cluster", (F.floor(F.sum("size").over(before) / BLOCK_SHINGLES) * PARTS + F.col("part")).alias("block"))
    totals = sized.groupBy("cluster").agg(F.sum("size").alias("total"))
    # a small cluster is one block
    blocks = blocks.join(totals, "cluster").select("node", "cluster", F.when(F.col("total") <= BLOCK_SHINGLES, F.lit(0).cast("long")).otherwise(F.col("block")).alias("block"))
    blocks = written(blocks, "blocks")
    there = blocks.groupBy("cluster").agg(F.sort_array(F.collect_set("block")).alias("others"))
    pairs = blocks.join(there, "cluster").select("node", "cluster", "block", F.explode("others").alias("other"))
    pairs = pairs.select("node", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return pairs.join(sets, "node").groupBy("cluster", "low", "high").applyInPandas(_overlaps(similarity), "a long, b long")


def near_texts(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, node, component_id, text_h, text_n per row of docs: the smallest doc_id that can be reached over links.

    Null, empty and blank texts are one node. Rows that repeat a doc_id are rows of their own. A null doc_id is the
    smallest of no component, unless there is no other, where component_id is null. An empty table gives an empty result.
    """
    docs = pick(docs, "doc_id", "text")
    prints = written(docs.select("doc_id", *text_key(F.col("text")), _print(utf8(F.col("text"))).alias("p")).select("doc_id", "text_h", "text_n", "p.*"), "prints")
    one = F.min(F.struct("text_h", "text_n")).alias("t")
    groups = prints.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), one)
    groups = written(groups.select("node", "first_doc", "n", "fp", "keys", "t.*"), "groups")
    found = _within_radius(groups.where("n > 0"), radius)
    joined = _joined(_alike(docs, groups, written(found, "pairs"), similarity))
    roots = joined.select(F.col("was").alias("node"), F.col("now").alias("root"))
    rows = groups.select(F.explode("keys").alias("key"), "node", "n")
    for by_bands in (True, False):
        rows = rows.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
        pairs, rest = _candidates(rows, similarity)
        roots = _merged(roots, _alike(docs, groups, written(pairs, "pairs"), similarity))
        rest = written(rest, "rest")
        if rest.isEmpty():
            break
        sets = _sets(docs, groups, rest.select("node").distinct())
        if by_bands:  # large buckets of texts that share bands but not the similarity part at their rare shingles
            rows = written(_rare_shingles(sets, similarity), "rare")
        else:
            roots = _merged(roots, _alike_in_blocks(rest, sets, similarity))
    rooted = groups.select("node", "first_doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = written(rooted.join(heads, "root").select("node", "component_id"), "classes")
    return prints.select("doc_id", "node", "text_h", "text_n").join(classes, "node").select("doc_id", "node", "component_id", "text_h", "text_n")


def keep_one_text(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, of which each is the smallest doc_id of its component.

    Of rows that repeat that doc_id one stays. Rows whose component has no doc_id at all stay. Null, empty and blank texts
    are one component. An empty table stays empty.
    """
    return keep_least(docs, near_texts(docs, similarity))
