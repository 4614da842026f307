"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Every bit position of a fingerprint is given a nonzero vector of radius + 1 bits. Each nonzero vector v makes a
table whose mask keeps the bits with an odd product with v. At most `radius` differing bits span at most `radius`
dimensions, so some v is orthogonal to all of them and its table puts the pair in one bucket: no pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, pick, table, text_key, utf8, written
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: A bucket of more distinct fingerprints is divided by a second covering of the bits that its mask leaves free.
MAX_BUCKET = 2048


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; no hashes: zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the word shingles of a whole text (its bytes, whatever they are), A-Z in lower case; no words: zero."""
    words = (text or b"").lower().split()  # of bytes, lower() and split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - SHINGLE + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())), "<u8", len(starts))
    return simhash(hashes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_h, text_n, fp: the text's key, and the fingerprint's 64 bits as a signed number."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))

    return pick(docs, "doc_id", "text").select("doc_id", *text_key(F.col("text")), of(utf8(F.col("text"))).alias("fp"))


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """2^(radius+1) - 1 masks over these bit positions."""
    size = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((i % size + 1) & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spanning_links(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that join the same fingerprints as all links within the radius would, at most one fewer than fps."""
    a: list[int] = []
    b: list[int] = []
    rest = fps.view(np.uint64)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                a += [int(np.int64(x.view(np.int64)))] * len(found)
                b += found.view(np.int64).tolist()
                queue.extend(found)
    return a, b


class _BucketLinks:
    """Over rows (table_no, key, fp) sorted by (table_no, key): links of each bucket as (-1, a, b).

    Of a bucket beyond the limit, the fingerprints come out as (table_no, fp, 0) instead, as they stream by.
    """

    def __init__(self, radius: int, limit: int | None):
        self.radius, self.limit = radius, limit

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = np.empty((0, 3), np.int64)  # the bucket that the last batch has not closed
        streaming = None  # the bucket beyond the limit that passes just now
        for pdf in batches:
            rows = np.concatenate([carry, pdf[["table_no", "key", "fp"]].to_numpy(np.int64)])
            out, carry, streaming = self.step(rows, streaming, last=False)
            if len(out):
                yield out
        out, _, _ = self.step(carry, streaming, last=True)
        if len(out):
            yield out

    def step(self, rows: np.ndarray, streaming: tuple | None, last: bool) -> tuple[pd.DataFrame, np.ndarray, tuple | None]:
        carry = rows[:0]
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        if len(rows):
            edges = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
            starts, stops = np.concatenate(([0], edges)), np.concatenate((edges, [len(rows)]))
            first = 0
            if streaming is not None and tuple(rows[0, :2]) == streaming:
                self.stream(rows[: stops[0]], out)
                first = 1
            if not last and len(starts) > first:
                tail = rows[starts[-1] :]
                starts, stops = starts[:-1], stops[:-1]
                if self.limit is not None and len(tail) > self.limit:
                    self.stream(tail, out)
                    streaming = tuple(tail[0, :2])
                else:
                    carry = tail
            starts, stops = starts[first:], stops[first:]
            pairs = starts[stops - starts == 2]  # most buckets have one row or two: those are compared all at once
            x, y = np.ascontiguousarray(rows[pairs, 2]), np.ascontiguousarray(rows[pairs + 1, 2])
            near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= self.radius
            self.add(out, x[near].tolist(), y[near].tolist())
            for k in np.flatnonzero(stops - starts > 2):
                part = rows[starts[k] : stops[k]]
                if self.limit is not None and len(part) > self.limit:
                    self.stream(part, out)
                else:
                    self.add(out, *spanning_links(np.ascontiguousarray(part[:, 2]), self.radius))
        return pd.DataFrame({k: np.array(v, np.int64) for k, v in zip(("kind", "a", "b"), out)}), carry, streaming

    @staticmethod
    def stream(part: np.ndarray, out: tuple) -> None:
        for to, values in zip(out, (part[:, 0].tolist(), part[:, 2].tolist(), [0] * len(part))):
            to.extend(values)

    @staticmethod
    def add(out: tuple, a: list[int], b: list[int]) -> None:
        for to, values in zip(out, ([-1] * len(a), a, b)):
            to.extend(values)


def _links_of(keyed: DataFrame, radius: int, limit: int | None) -> DataFrame:
    dealt = keyed.repartition(partitions(keyed.sparkSession), "table_no", "key").sortWithinPartitions("table_no", "key", "fp")
    return dealt.mapInPandas(_BucketLinks(radius, limit).__call__, "kind long, a long, b long")


def near_links(fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect whatever links within the radius connect."""
    spark = fps.sparkSession
    first = covering_masks(list(range(64)), radius)
    masks = F.array(*[F.struct(F.lit(v).cast("long").alias("no"), F.lit(_signed(m)).cast("long").alias("mask")) for v, m in enumerate(first)])
    keyed = fps.select("fp", F.explode(masks).alias("t")).select(F.col("t.no").alias("table_no"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), "fp")
    found = written(_links_of(keyed, radius, max_bucket), "links")
    links = found.where("kind = -1").select("a", "b")
    large = found.where("kind >= 0").select(F.col("kind").alias("table_no"), F.col("a").alias("fp"))
    # in a large bucket, all differences lie in the bits its mask leaves free; a covering of those divides it into
    # buckets that share all but about 16 bits: at most some 2^16 distinct fingerprints, whatever the input
    second = []
    for v, m in enumerate(first):
        free = [b for b in range(64) if not m >> b & 1]
        second += [(v, v * 64 + u, _signed(m | s)) for u, s in enumerate(covering_masks(free, radius))]
    finer = F.broadcast(spark.createDataFrame(second, "of long, table_no long, mask long"))  # 31 x 31 rows
    deeper = large.withColumnRenamed("table_no", "of").join(finer, "of").select("table_no", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return links.union(_links_of(deeper, radius, None).select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id, text_h, text_n per row of docs: the smallest doc_id that can be reached over links.

    Fingerprints link at `radius` or fewer differing bits. Null, empty and blank texts have fingerprint zero and
    link like others. Rows that repeat a doc_id are rows of their own. A null doc_id is the smallest of no
    component, unless there is no other, where component_id is null. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs), "prints")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "groups")
    roots = components(near_links(groups.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = written(rooted.join(heads, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "text_h", "text_n")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, with all their columns, of which each is the smallest doc_id of its component.

    Of rows that repeat that doc_id one stays. Rows whose component has no doc_id at all stay.
    """
    return keep_least(docs, near_duplicates(docs, radius))


def keep_least(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """As keep_one, by classes (doc_id, component_id, text_h, text_n). Texts move once at most."""
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.col("doc_id").alias("row_id"), F.struct("*").alias("all"))
    # the join deals rows out by doc_id, so rows that repeat one already lie together
    known = rows.where("row_id is not null").join(kept, F.col("row_id") == F.col("kept_id"), "left_semi").groupBy("row_id").agg(F.first("all").alias("all")).select("all.*")
    # rows without doc_id are told apart by their texts
    lone = classes.where("doc_id is null and component_id is null").select(F.col("text_h").alias("of_h"), F.col("text_n").alias("of_n")).distinct()
    unknown = rows.where("row_id is null").select("all", *text_key(F.col("all.text"))).join(lone, (F.col("text_h") == F.col("of_h")) & (F.col("text_n") == F.col("of_n")), "left_semi")
    return known.unionByName(unknown.select("all.*"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
