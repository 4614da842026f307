"""A Merkle manifest of a table: a root over all documents, and for every document the path that proves it.

Leaves of a language ascend by doc_id. They are dealt into aligned blocks of 2^HEIGHT leaves, which are subtrees. The
roots of the blocks are the leaves of the next round, until one node is left per language; the languages' subroots are
folded the same way. No block, and so no task, grows with the table. In a block, authentication paths advance leaf by
leaf: one treehash stack per level prepares the sibling that its level needs next, and each step gives its units of work
to the stack with the lowest tail node. So a block holds its leaves and a logarithmic number of nodes, never its tree.
Above the block the path is the same for all its leaves and is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, pick, table, written

#: Levels of a block.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DONE = 1 << 30


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def parent(left: str | None, right: str | None) -> str | None:
    """A run of two, of one, or of none, which lies beyond the last leaf."""
    return None if left is None else digest(left, right or "")


class Treehash:
    """Builds the node of a height over the leaves from `at` on, one leaf or one parent a step."""

    def __init__(self, height: int, at: int):
        self.height, self.at, self.stack = height, at, []

    @property
    def low(self) -> int:
        """Height of the lowest node held; that of the goal before the first leaf, and beyond all heights when done."""
        if not self.stack:
            return self.height
        return _DONE if self.stack[0][0] == self.height else self.stack[-1][0]

    def step(self, leaves: Sequence[str]) -> None:
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            (h, right), (_, left) = s.pop(), s.pop()
            s.append((h + 1, parent(left, right)))
        else:
            s.append((0, leaves[self.at] if self.at < len(leaves) else None))
            self.at += 1


def first_nodes(leaves: Sequence[str], levels: int) -> tuple[str, list[str | None], list[str | None]]:
    """The root of a block, and of every level below it the first and the second node."""
    firsts: list[list[str | None]] = [[] for _ in range(levels + 1)]
    stack: list[tuple[int, str | None]] = []
    for i in range(1 << levels):
        h, value = 0, leaves[i] if i < len(leaves) else None
        while True:
            if len(firsts[h]) < 2:
                firsts[h].append(value)
            if not stack or stack[-1][0] != h:
                break
            value, h = parent(stack.pop()[1], value), h + 1
        stack.append((h, value))
    return firsts[levels][0], [f[0] for f in firsts[:levels]], [f[1] for f in firsts[:levels]]


def root_of(leaves: Sequence[str], levels: int) -> str:
    """The root of a block, by levels: a block is bounded, and parents of nothing cost nothing."""
    now = list(leaves)
    for _ in range(levels):
        now = [digest(*now[i : i + 2]) for i in range(0, len(now), 2)]
    return now[0]


def traverse(leaves: Sequence[str], levels: int) -> Iterator[list[str | None]]:
    """For every leaf in order, its siblings level by level (None where its run has no other)."""
    _, left, auth = first_nodes(leaves, levels)
    stacks = [Treehash(h, 0) for h in range(levels)]
    for h, s in enumerate(stacks):
        s.stack = [(h, left[h])]
    low = [_DONE] * levels
    for s in range(len(leaves)):
        yield list(auth)
        for h in range(levels):
            if (s + 1) & ((1 << h) - 1):
                break
            auth[h] = stacks[h].stack[0][1] if stacks[h].stack else None
            start = (s + 1 + (1 << h)) ^ (1 << h)
            stacks[h] = Treehash(h, start)
            low[h] = h if start < 1 << levels else _DONE
        for _ in range(2 * levels - 1):
            least = min(low)
            if least == _DONE:
                break
            h = low.index(least)
            stacks[h].step(leaves)
            low[h] = stacks[h].low


def fold(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf and its path give. A step is '<' and the sibling on the left, '>' and that on the right, or ''."""
    for step in path:
        leaf = digest(step[1:], leaf) if step[:1] == "<" else digest(leaf, step[1:])
    return leaf


def _steps(pos: int, siblings: Sequence[str | None]) -> list[str]:
    return ["" if x is None else ("<" if pos >> h & 1 else ">") + x for h, x in enumerate(siblings)]


def _levels(total: int, height: int) -> int:
    """Levels of a block: all of them if its tree has further blocks, else as many as its nodes need."""
    return height if total > 1 << height else (total - 1).bit_length()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**other: Column) -> Column:
    """The leaf of a document; other columns may stand in for its own."""
    return F.sha2(F.concat(*[_field(other.get(c, F.col(c))) for c in FIELDS]), 256)


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, the 0-based place within `tree` by order, and total, the tree's size.

    Rows are sorted over ranges of (tree, order), so a tree of any size is many tasks; places are taken from one
    summary row per range and tree.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    sums = written(placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("low"), F.count("*").alias("n")), "sums")
    of = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("tree", "part", (before - F.col("low")).alias("shift"), F.sum("n").over(of).alias("total"))
    return placed.withColumn("part", part).join(sums, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _block(height: int) -> Column:
    return F.shiftright("pos", height).alias("block")


def _rounds(nodes: DataFrame, height: int) -> list[DataFrame]:
    """nodes (tree, pos, total, digest), and round by round the roots of their blocks, until every tree is one node."""

    def roots(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, total = pdf.sort_values("pos"), int(pdf["total"].iloc[0])
        return pd.DataFrame([(key[0], key[1], (total + (1 << height) - 1) >> height, root_of(pdf["digest"].tolist(), _levels(total, height)))], columns=["tree", "pos", "total", "digest"])

    out, most = [nodes], nodes.agg(F.max("total")).first()[0] or 1
    while most > 1:
        up = out[-1].select("tree", "pos", "total", "digest").groupBy("tree", _block(height)).applyInPandas(roots, "tree string, pos bigint, total bigint, digest string")
        out.append(written(up, "roots"))
        most = (most + (1 << height) - 1) >> height
    return out


def _paths(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """tree, pos, path of every node: its siblings within the block, then the path of the block (upper: tree, pos, path)."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, above = left.sort_values("pos"), list(right["path"].iloc[0])
        pos = left["pos"].tolist()
        walk = traverse(left["digest"].tolist(), _levels(int(left["total"].iloc[0]), height))
        return pd.DataFrame({"tree": key[0], "pos": pos, "path": [_steps(p, x) + above for p, x in zip(pos, walk)]})

    groups = nodes.select("tree", "pos", "total", "digest").groupBy("tree", _block(height)).cogroup(upper.groupBy("tree", F.col("pos").alias("block")))
    return groups.applyInPandas(run, "tree string, pos bigint, path array<string>")


def _all_paths(rounds: list[DataFrame], top: DataFrame, height: int) -> DataFrame:
    """tree, pos, path of the blocks that the first round's nodes lie in; top has the paths of the last round's."""
    paths = top
    for nodes in rounds[-2:0:-1]:
        paths = written(_paths(nodes, paths, height), "paths")
    return paths


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root per row of docs (doc_id, source, lang, n_chars, text).

    path proves a leaf: fold(leaf, path) is the root. folded_root is folded from tampered, a leaf of the
    same row (null: from its own leaf). A null field is a leaf's "-"; null doc_ids come first, and rows that repeat a
    doc_id are leaves of their own, ordered by digest. A null lang is a language of its own, the first. Other
    columns are left out. An empty table has an empty manifest.
    """
    rows = pick(docs, *FIELDS)
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree")
    leaves = rows.select(tree, "doc_id", leaf_digest().alias("digest"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    rounds = _rounds(written(_ranked(leaves, "doc_id", "digest", "tampered"), "leaves"), height)
    subroots = rounds[-1].select("tree", F.col("digest").alias("subroot"))
    # the languages are the leaves of one more tree
    langs = written(_ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("subroot").alias("digest")), "lang"), "langs")
    over = _rounds(langs, height)
    root = (over[-1].select("digest").head() or [None])[0]
    end = over[-1].select("tree", "pos", F.array().cast("array<string>").alias("path"))
    steps = _paths(langs, _all_paths(over, end, height), height) if len(over) > 1 else end
    # what stands above a language's subroot, beside that subroot
    head = written(steps.drop("tree").join(langs.select("pos", "lang", "digest"), "pos").select(F.col("lang").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("digest").alias("subroot")), "heads")
    blocks = _all_paths(rounds, head.select("tree", "pos", "path"), height)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, above = left.sort_values("pos"), list(right["path"].iloc[0])
        levels = _levels(int(left["total"].iloc[0]), height)
        known: dict[str, str] = {}  # leaves that aren't tampered with all meet in the block's root
        out = []
        for pos, leaf, other, siblings in zip(left["pos"].tolist(), left["digest"], left["tampered"], traverse(left["digest"].tolist(), levels)):
            own = _steps(pos, siblings)
            there = fold(other if isinstance(other, str) else leaf, own)
            if there not in known:
                known[there] = fold(there, above)
            out.append((own + above, known[there]))
        return pd.DataFrame({"tree": key[0], "doc_id": left["doc_id"].to_numpy(), "leaf": left["digest"].to_numpy(), "path": [x[0] for x in out], "folded_root": [x[1] for x in out]})

    first = rounds[0].select("tree", "pos", "total", "digest", "doc_id", "tampered")
    if len(rounds) == 1:  # every language is one leaf, and the path of its block is its own
        blocks = head.select("tree", "pos", "path")
    done = first.groupBy("tree", _block(height)).cogroup(blocks.groupBy("tree", F.col("pos").alias("block"))).applyInPandas(run, "tree string, doc_id bigint, leaf string, path array<string>, folded_root string")
    known = head.select("tree", "subroot")
    return done.join(known, "tree").select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "path", "folded_root")


def with_more_chars() -> Column:
    """The leaf of a row whose n_chars was raised by one, where 7 divides the checksum of doc_id; elsewhere null."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_digest(n_chars=more))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(table(spark, sf_dir, "documents"), with_more_chars())
    siblings = F.array_join(F.transform("path", lambda x: F.substring(x, 2, 64)), "")
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEAF = "sha256(concat({}))"
_SQL_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"


def _sql_leaf(n_chars: str) -> str:
    return _LEAF.format(", ".join(_SQL_FIELD.format(n_chars if c == "n_chars" else c) for c in FIELDS))


ORACLE_SQL = f"""
with recursive crc(i, k, c) as (
  select i, 0, i::ubigint from range(256) r(i)
  union all select i, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from crc where k < 8),
crcs as (select list(c order by i) as t from crc where k = 8),
d as (select *, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ord(substr(doc_id::varchar, i, 1))::ubigint) as b, coalesce('=' || lang, '-') as tree from documents),
leaves as (
  select doc_id, tree, {_sql_leaf('n_chars')} as leaf,
    case when xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::int + 1])), 4294967295::ubigint) % 7 = 0 then {_sql_leaf('(n_chars::hugeint + 1)')} end as tampered
  from d, crcs),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from leaves),
nodes(level, tree, pos, n, digest) as (
  select 0, tree, pos, count(*) over (partition by tree), leaf from placed
  union all
  select level + 1, tree, pos // 2, (n + 1) // 2, sha256(digest || coalesce(lead(digest) over (partition by tree order by pos), '')) from nodes where n > 1 qualify pos % 2 = 0),
subroots as (select tree, digest, level, row_number() over (order by tree) - 1 as pos from nodes where n = 1),
tops(level, pos, n, digest) as (
  select 0, pos, count(*) over (), digest from subroots
  union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(digest || coalesce(lead(digest) over (order by pos), '')) from tops where n > 1 qualify pos % 2 = 0),
root as (select digest as root from tops where n = 1),
steps as (
  select p.tree, p.pos, x.level, (x.pos % 2 = 1) as odd, y.digest as sibling
  from placed p join nodes x on x.tree = p.tree and x.n > 1 and x.pos = p.pos >> x.level
  left join nodes y on y.tree = x.tree and y.level = x.level and y.pos = xor(x.pos, 1::bigint)
  union all
  select p.tree, p.pos, s.level + x.level, x.pos % 2 = 1, y.digest
  from placed p join subroots s on s.tree = p.tree join tops x on x.n > 1 and x.pos = s.pos >> x.level
  left join tops y on y.level = x.level and y.pos = xor(x.pos, 1::bigint)),
paths as (select tree, pos, list(case when odd then '<' else '>' end || coalesce(sibling, '') order by level) as path, coalesce(string_agg(sibling, '' order by level), '') as proof from steps group by tree, pos),
whole as (select p.*, coalesce(path, []) as path, coalesce(proof, '') as proof, s.digest as subroot from placed p join subroots s on s.tree = p.tree left join paths q on q.tree = p.tree and q.pos = p.pos),
folded as (
  select *, list_reduce(list_prepend(coalesce(tampered, leaf), path), lambda v, x: case when x[1] = '<' then sha256(x[2:] || v) else sha256(v || x[2:]) end) as folded_root from whole)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded_root, folded_root = root as verified from folded, root
"""
