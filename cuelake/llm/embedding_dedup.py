"""Near-duplicate embeddings: sign hashing by random hyperplanes in several tables, exact cosines, connected components.

Equal vectors are one node with a weight. A node's key in a table is the side of each of the table's hyperplanes that
it lies on; two vectors at the least cosine lie on the same side with probability 1 - angle / pi, which gives the number
of tables for a stated risk of missing such a pair. Buckets of few nodes give pairs, each pair in the first table that
has it, and only pairs that whole signatures leave in question; their cosine is computed in double precision.

A bucket of many nodes gives no pairs. Its dense part is a ball: nodes within half the largest angle of their common
centre, all linked with each other by the triangle inequality on the sphere, so a ball is counted and never compared.
What lies outside meets the bucket block by block, in tasks of bounded memory that return counts and spanning links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, small, table, written
from .components import components

COSINE, MISS, SEED = 0.93, 1e-5, 42
#: Nodes of a random bucket, about; nodes from which a bucket counts as large; nodes of a block of a large one.
PER_BUCKET, LARGE, BLOCK = 4, 32, 512
#: A pair at the least cosine is beyond the bound on differing signature bits in one of a billion cases (normal tail).
DEVIATIONS = 6.0
_ROUNDING = 1e-9
_BUCKET = ["label", "dim", "t", "key"]


def layout(n: int, cosine: float, miss: float) -> tuple[int, int, int]:
    """Hyperplanes of a table, tables, and the most signature bits in which a pair at the cosine differs, for n nodes of a label."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / PER_BUCKET))))
    tables = math.ceil(math.log(miss) / math.log1p(-(agree**bits)))
    all_bits = bits * tables
    return bits, tables, math.ceil(all_bits * (1 - agree) + DEVIATIONS * math.sqrt(all_bits * agree * (1 - agree)))


@lru_cache(maxsize=8)
def _planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; entries of any size don't overflow."""
    x = rows / np.abs(rows).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column) -> np.ndarray:
    """A row per vector of a pandas or Arrow column; all are of one size."""
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.array([np.asarray(x, np.float64) for x in column])


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, and 128 bits that tell vectors of a label apart (null: the row can't link)."""
    ids = F.col("vec_id") if "vec_id" in vectors.columns else F.lit(None)
    rows = vectors.select(ids.cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    ok = F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda c: c != 0)
    return rows.withColumns({"h1": F.when(ok, F.xxhash64("label", "embedding")), "h2": F.when(ok, F.xxhash64(F.lit(1), "embedding", "label"))})


def _nodes(vectors: DataFrame) -> DataFrame:
    """node, label, dim, h1, h2, embedding, weight, first_id per distinct vector that can link: of a label, finite, not zero."""
    per = _rows(vectors).where("h1 is not null").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("vec_id").alias("first_id"))
    # the number of a node is fixed by the table that holds it
    return written(per.select(F.monotonically_increasing_id().alias("node"), "label", F.size("embedding").alias("dim"), "h1", "h2", "embedding", "weight", "first_id"), "nodes")


def _signed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """node, label, dim, weight, keys: a key of `bits` signs per table."""
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                for at in range(0, own.num_rows, 2048):
                    part = own.slice(at, 2048)
                    x = unit(_matrix(part.column("embedding")))
                    keys = ((x @ _planes(int(dim), bits * tables, SEED) > 0).reshape(len(x), tables, bits) @ powers).astype(np.int32)
                    lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * tables, keys.ravel())
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "label", "dim", "weight")), lists], ["node", "label", "dim", "weight", "keys"])

    return nodes.select("node", "label", "dim", "weight", "embedding").mapInArrow(run, "node bigint, label bigint, dim int, weight bigint, keys array<int>")


@F.pandas_udf(T.DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    sizes = a.map(len)
    out = np.zeros(len(a))
    for n in sizes.unique():
        own = (sizes == n).to_numpy()
        out[own] = (unit(_matrix(a[own])) * unit(_matrix(b[own]))).sum(1)
    return pd.Series(out)


def _balls(rows: DataFrame, large: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """node, ball: what of the large buckets lies within half the angle of a common centre; ball is its least node.

    A node goes with the first head, in a fixed random order, of its large buckets, so one dense group mostly has one. The
    centre is the mean direction of those that go with a head. A centre is summed per dimension, which merges in each task.
    """
    order = F.struct(F.xxhash64("head").alias("o"), "head")
    chosen = written(rows.join(large, _BUCKET).groupBy("node").agg(F.min(order)["head"].alias("head")), "chosen")
    with_head = written(chosen.join(nodes.select("node", "embedding"), "node"), "with_head")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, dims = b.column("head").to_numpy(), b.column("embedding").value_lengths().to_numpy()
            for dim in np.unique(dims):
                own = dims == dim
                head, place = np.unique(heads[own], return_inverse=True)
                total = np.zeros((len(head), dim))
                np.add.at(total, place, unit(_matrix(b.column("embedding").filter(pa.array(own)))))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(head, dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(head))), pa.array(total.ravel())], ["head", "i", "s"])

    parts = with_head.select("head", "embedding").mapInArrow(sums, "head bigint, i int, s double").groupBy("head", "i").agg(F.sum("s").alias("s"))
    centres = parts.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("centre"))
    centres = written(centres.where(F.exists("centre", lambda c: c != 0)), "centres")
    reach = math.cos(math.acos(cosine) / 2 - _ROUNDING)
    inside = written(with_head.join(centres, "head").where(_cosine("embedding", "centre") >= reach).select("node", "head"), "inside")
    first = written(inside.groupBy("head").agg(F.min("node").alias("ball"), F.count("*").alias("n")).where("n > 1"), "firsts")
    return written(inside.join(first, "head").select("node", "ball"), "balls")


def _small_pairs(rows: DataFrame, tables: int, most_bits: int) -> DataFrame:
    """a, b: pairs of the small buckets that whole signatures leave in question, each from the first table that has it.

    Rows (node, ball, keys and the bucket's columns) come sorted by bucket; pairs of one ball are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the bucket that the last batch has not closed
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(c).to_numpy().astype(np.int64) for c in _BUCKET], 1)
            opens = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            if len(opens):
                yield pairs([*held, b.slice(0, opens[-1])])
                held = [b.slice(opens[-1])]
            elif held and (np.array([held[0].column(c)[0].as_py() for c in _BUCKET]) != ids[0]).any():
                yield pairs(held)
                held = [b]
            else:
                held.append(b)
        if held:
            yield pairs(held)

    def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(parts).combine_chunks()
        ids = np.stack([b.column(c).to_numpy().astype(np.int64) for c in _BUCKET], 1)
        node, ball, t = b.column("node").to_numpy(), b.column("ball").to_numpy(), ids[:, 2]
        keys = b.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, tables)
        bucket = np.concatenate(([0], np.cumsum((ids[1:] != ids[:-1]).any(1))))
        out: tuple[list, list] = ([], [])
        for apart in range(1, int(np.bincount(bucket).max())):
            x = np.flatnonzero(bucket[apart:] == bucket[:-apart])
            y = x + apart
            other = (ball[x] != ball[y]) | (ball[x] < 0)
            x, y = x[other], y[other]
            for at in range(0, len(x), 65536):
                p, q = x[at : at + 65536], y[at : at + 65536]
                differ = keys[p] ^ keys[q]
                ok = (np.argmax(differ == 0, 1) == t[p]) & (np.bitwise_count(differ).sum(1, dtype=np.int64) <= most_bits)
                out[0].append(node[p[ok]])
                out[1].append(node[q[ok]])
        a, c = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in out)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    dealt = rows.select(*_BUCKET, "node", "ball", "keys").repartition(partitions(rows.sparkSession), *_BUCKET).sortWithinPartitions(*_BUCKET)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of these links, ones that join the same."""
    least: dict[int, int] = {}

    def root(v: int) -> int:
        while least.get(v, v) != v:
            least[v] = least.get(least[v], least[v])
            v = least[v]
        return v

    kept = []
    for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
        p, q = root(x), root(y)
        if p != q:
            least[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _large_links(rows: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """kind 0: node a has b further links by weight; kind 1: groups a and b (balls, or nodes outside any) are linked.

    Rows are those of large buckets. A part of a bucket is a ball with more than a block of nodes there, or the rest; parts are
    dealt into blocks, and every two blocks meet in one task, but those of one ball. A bucket that is one ball has no task.
    """
    per = rows.groupBy(*_BUCKET, "ball").agg(F.count("*").alias("c"))
    part = F.when((F.col("ball") >= 0) & (F.col("c") > BLOCK), F.col("ball")).otherwise(F.lit(-1)).alias("part")
    parts = per.select(*_BUCKET, "ball", "c", part).groupBy(*_BUCKET, "part").agg(F.sum("c").alias("c"), F.count("*").alias("n_balls"), F.min("ball").alias("least"))
    sized = parts.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.col("part").alias("part"), i.alias("i")))
    lists = sized.groupBy(*_BUCKET).agg(F.flatten(F.collect_list(blocks)).alias("there"), F.sum("n_balls").alias("n_balls"), F.min("least").alias("least"))
    lists = written(lists.where("n_balls > 1 or least < 0").drop("n_balls", "least"), "lists")
    # a row's part is its ball where that is a part of the bucket
    some = rows.join(lists, _BUCKET).withColumn("part", F.when(F.exists("there", lambda b: b["part"] == F.col("ball")), F.col("ball")).otherwise(F.lit(-1)))
    n = F.size(F.filter("there", lambda b: b["part"] == F.col("part")))
    some = some.withColumn("i", F.pmod(F.xxhash64("node"), n).cast("int"))
    own = F.struct(F.col("part").alias("part"), F.col("i").alias("i"))
    others = F.filter("there", lambda b: (F.col("part") < 0) | (b["part"] != F.col("part")))
    met = some.select(*_BUCKET, "node", "ball", "weight", "keys", own.alias("own"), F.explode(others).alias("other"))
    met = met.select(*_BUCKET, "node", "ball", "weight", "keys", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("is_low"))
    met = met.join(nodes.select("node", "embedding"), "node")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, one = int(key[2]), key[4] == key[6] and key[5] == key[7]
        pdf = pdf.sort_values("node", kind="stable")
        x, y = (pdf, pdf) if one else (pdf[pdf["is_low"]], pdf[~pdf["is_low"]])
        if not len(x) or not len(y):
            return pd.DataFrame({"kind": [], "a": [], "b": []})
        p, q = np.nonzero(unit(_matrix(x["embedding"])) @ unit(_matrix(y["embedding"])).T >= cosine)
        p, q = (p[p < q], q[p < q]) if one else (p, q)
        bx, by = x["ball"].to_numpy(), y["ball"].to_numpy()
        apart = (bx[p] != by[q]) | (bx[p] < 0)
        p, q = p[apart], q[apart]
        kx, ky = np.stack(x["keys"].to_list()), np.stack(y["keys"].to_list())
        first = np.concatenate([np.argmax(kx[p[at : at + 65536]] == ky[q[at : at + 65536]], 1) == t for at in range(0, len(p), 65536)]) if len(p) else np.zeros(0, bool)
        p, q = p[first], q[first]
        nx, ny = x["node"].to_numpy(), y["node"].to_numpy()
        count = pd.concat([pd.Series(y["weight"].to_numpy()[q]).groupby(nx[p]).sum(), pd.Series(x["weight"].to_numpy()[p]).groupby(ny[q]).sum()])
        gx, gy = np.where(bx < 0, nx, bx), np.where(by < 0, ny, by)
        links = _spanning(gx[p], gy[q])
        return pd.DataFrame({"kind": [0] * len(count) + [1] * len(links), "a": [*count.index, *(k[0] for k in links)], "b": [*count.to_list(), *(k[1] for k in links)]}, dtype=np.int64)

    blocks_of = [F.col("low.part").alias("p1"), F.col("low.i").alias("i1"), F.col("high.part").alias("p2"), F.col("high.i").alias("i2")]
    return met.groupBy(*_BUCKET, *blocks_of).applyInPandas(run, "kind int, a bigint, b bigint")


def near_embeddings(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of vectors (vec_id, embedding, label).

    Vectors of one label and size link at the cosine or more. n_links counts rows, so equal vectors are links of each other. A
    pair at exactly the cosine is missed with probability `miss`, a closer one more seldom; no link is below it. A vector that
    is null, empty, zero, or holds a null or non-finite entry links with nothing, nor does one without label.
    Rows that repeat a vec_id are rows of their own. A null vec_id is the smallest of no component, unless there is no
    other, where component_id is null; kept is vec_id = component_id, nulls being equal. Other columns are left out.
    An empty table gives an empty result.
    """
    nodes = _nodes(vectors)
    most = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables, most_bits = layout(most, cosine, miss)
    signed = written(_signed(nodes, bits, tables), "signed")
    rows = signed.select("node", "label", "dim", "weight", "keys", F.posexplode("keys").alias("t", "key"))
    large = written(rows.groupBy(*_BUCKET).agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("o"), "node"))["node"].alias("head")).where(F.col("n") > LARGE).drop("n"), "large")
    n_large = large.count()
    large = small(large, 64 * n_large)
    nothing = nodes.sparkSession.createDataFrame([], "kind int, a bigint, b bigint")
    if n_large:
        balls = _balls(rows.select("node", *_BUCKET), large, nodes, cosine)
        signed = written(signed.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", F.lit(-1).cast("bigint"))), "grouped")
        rows = signed.select("node", "label", "dim", "weight", "ball", "keys", F.posexplode("keys").alias("t", "key"))
        by_blocks = written(_large_links(rows.join(large.drop("head"), _BUCKET), nodes, cosine), "by_blocks")
        rows = rows.join(large.drop("head"), _BUCKET, "left_anti")
    else:
        by_blocks = nothing
        signed = signed.withColumn("ball", F.lit(-1).cast("bigint"))
        rows = rows.withColumn("ball", F.lit(-1).cast("bigint"))
    pairs = written(_small_pairs(rows, tables, most_bits), "pairs")
    vec = nodes.select("node", "embedding")
    left, right = vec.select(F.col("node").alias("a"), F.col("embedding").alias("x")), vec.select(F.col("node").alias("b"), F.col("embedding").alias("y"))
    links = written(pairs.join(left, "a").join(right, "b").where(_cosine("x", "y") >= cosine).select("a", "b"), "links")
    # balls and nodes outside any are what links connect
    group = F.when(F.col("ball") < 0, F.col("node")).otherwise(F.col("ball")).alias("group")
    of = written(signed.select("node", "weight", "ball", group), "of")
    side = lambda c, *more: of.select(F.col("node").alias(c), F.col("group").alias(f"{c}_group"), *[F.col(m).alias(f"{c}_{m}") for m in more])
    between = written(links.join(side("a", "weight"), "a").join(side("b", "weight"), "b"), "between")
    edges = between.select(F.col("a_group").alias("a"), F.col("b_group").alias("b")).union(by_blocks.where("kind = 1").select("a", "b")).where("a <> b").distinct()
    roots = written(components(edges), "roots")
    per_ball = written(of.where("ball >= 0").groupBy("ball").agg(F.sum("weight").alias("in_ball")), "per_ball")
    counts = between.select(F.col("a").alias("node"), F.col("b_weight").alias("n")).union(between.select("b", "a_weight")).union(by_blocks.where("kind = 0").select("a", "b"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    joined = nodes.select("node", "h1", "h2", "first_id").join(of, "node").join(per_ball, "ball", "left").join(counts, "node", "left").join(roots.select(F.col("node").alias("group"), "root"), "group", "left")
    n_links = F.coalesce("in_ball", "weight") - 1 + F.coalesce("n", F.lit(0))
    joined = written(joined.select("h1", "h2", "first_id", n_links.alias("n_links"), F.coalesce("root", "group").alias("root")), "joined")
    firsts = written(joined.groupBy("root").agg(F.min("first_id").alias("component_id")), "firsts")
    classes = written(joined.join(firsts, "root").select("h1", "h2", "n_links", "component_id"), "classes")
    found = _rows(vectors).select("vec_id", "h1", "h2").join(classes.withColumn("known", F.lit(True)), ["h1", "h2"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
with recursive v as (
  select row_number() over () as r, vec_id, label, embedding::double[] as e,
    embedding is not null and label is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x is not null and x <> 0)) as ok
  from embeddings),
g as (select r, vec_id, label, len(e) as d, e, sqrt(list_dot_product(e, e)) as n from v where ok),
links as (select a.r as a, b.r as b from g a join g b on a.label = b.label and a.d = b.d and a.r <> b.r and list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
reach(a, b) as (select r, r from v union select reach.a, links.b from reach join links on links.a = reach.b),
first as (select a as r, min(vec_id) as component_id from reach join v on v.r = reach.b group by a),
n as (select a as r, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id is not distinct from component_id as kept from v join first using (r) left join n using (r)
"""
