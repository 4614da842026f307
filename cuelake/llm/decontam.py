"""Benchmark decontamination, with DataFrame functions only.

Windows as long as the item are fingerprinted by SimHash. Windows and items whose fingerprints differ in at most
`radius` of 64 bits agree in one of radius + 1 blocks, so an equality join on the blocks finds them all. Each pair
found is verified by the weighted Jaccard similarity of the two shingle multisets. A window that shares no shingle
with any item has similarity 0 to all of them; shared shingles tell beforehand which windows need a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, pick, small, table, words_of, written

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 two fingerprints differ in 9.7 bits on average, with a deviation of 2.9.
RADIUS = 18


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the word shingles, in order; fewer words than size give none."""
    one = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - size), one))


def hashed(text: Column, size: int = SHINGLE) -> Column:
    return let(words_of(ascii_lower(F.coalesce(text, F.lit("")))), lambda w: shingle_hashes(w, size))


def _majority(hashes: Column, width: int) -> Column:
    """simhash of fewer than 2^(width - 1) hashes: a sum holds 64 / width counters, so that width sums count all bits.

    Added to 2^(width - 1) - 1 less half of the hashes, a counter reaches its own highest bit if it is over half.
    """
    lanes = sum(1 << at for at in range(0, 32, width))
    mask, top = lanes | lanes << 32, lanes << (width - 1)
    zero = F.lit(0).cast("bigint")
    sum_of = lambda k: F.aggregate(hashes, zero, lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask)))
    rest = (F.lit((1 << (width - 1)) - 1).cast("bigint") - F.shiftright(F.size(hashes), 1)) * F.lit(lanes).cast("bigint")

    def bits(s: Column) -> Column:
        out, more = zero, F.get(s, F.lit(width))
        for k in range(width):
            x = F.get(s, F.lit(k))
            for half, at in ((x.bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftrightunsigned(x, 32), k + 32)):
                out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned((half + more).bitwiseAND(F.lit(top)), width - 1), at))
        return out

    return let(F.array(*[sum_of(k) for k in range(width)], rest), bits)


def simhash(hashes: Column, most: int = 1 << 30) -> Column:
    """64 bits, each set if it is set in over half of the hashes, of which there are at most so many."""
    short = _majority(hashes, 8)
    return short if most < 1 << 7 else F.when(F.size(hashes) < 1 << 7, short).otherwise(_majority(hashes, 32))


def blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 blocks of the 64 bits as array<struct<no,value>>: equal in one if at most radius bits differ."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    part = lambda a, b: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 63 else -1))
    return F.array(*[F.struct(F.lit(i).alias("no"), part(a, b).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def _multiset(hashes: Column) -> Column:
    """The multiset as a set: a hash's n-th copy becomes an element of its own."""

    def of(s: Column) -> Column:
        runs = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        copies = lambda r: F.flatten(F.transform(r, lambda a, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(r, k + 1), F.size(s)) - a - 1), lambda c: F.xxhash64(F.get(s, a), c))))
        return F.when(F.size(s) == 0, s).otherwise(let(runs, copies))

    return let(F.sort_array(hashes), of)


def _row_hash() -> Column:
    return F.xxhash64("text")


def _starts(at: Column, m: Column, n: Column, similarity: float) -> Column:
    """Starts of the m-shingle windows that begin or end at a hit and hold enough hits for the similarity.

    at: sorted hit positions, n: shingles of the document; windows that reach over its ends are cut there. A
    window that neither begins nor ends at a hit can be moved to one without losing similarity.
    """
    need = lambda a: F.greatest(F.ceil((a + m) * (similarity / (1 + similarity)) - 1e-9), F.lit(1)).cast("int")

    def begins(p: Column, i: Column) -> Column:
        t = need(F.least(m, n - p))
        return F.when(F.get(at, i + t - 1) < p + m, p)

    def ends(p: Column, i: Column) -> Column:
        t = need(F.least(m, p + 1))
        return F.when((i - t + 1 >= 0) & (F.get(at, i - t + 1) > p - m), p - m + 1)

    found = F.concat(F.transform(at, begins), F.transform(at, ends))
    return F.array_distinct(F.filter(found, lambda s: s.isNotNull()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start (word), n_words, distance: each document's best window for each item it leaks.

    A leak is an item-sized window with a weighted Jaccard similarity of at least `similarity` to the item, over
    shingles of five words with A-Z in lower case. An item of fewer words is one shingle, its whole sequence, and leaks
    where a document holds that sequence; null and blank items match nothing, and so do null and blank texts. Rows that
    repeat a doc_id share its row of the result; null doc_ids are one document. Items that repeat an item_id are
    searched for one by one; the best counts, ties by the first window. Empty tables give an empty result.
    """
    d = pick(docs, "doc_id", "text").where("text is not null")
    b = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("bigint").alias("item_id"), words_of(ascii_lower(F.coalesce("text", F.lit("")))).alias("words"))
    b = b.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(SHINGLE)))
    by_size = F.when(F.col("size") == SHINGLE, shingle_hashes(F.col("words")))
    for k in range(1, SHINGLE):
        by_size = by_size.when(F.col("size") == k, shingle_hashes(F.col("words"), k))
    b = b.select("item_id", "size", by_size.alias("item"))
    b = written(b.withColumns({"m": F.size("item"), "print": simhash(F.col("item"))}).distinct(), "items")
    facts = {r["size"]: (r["n"], r["shingles"], r["longest"]) for r in b.groupBy("size").agg(F.count("*").alias("n"), F.sum("m").alias("shingles"), F.max("m").alias("longest")).collect()}
    found = [_leaks_of(d, b.where(F.col("size") == k), k, *facts[k], similarity, radius) for k in sorted(facts, reverse=True)]
    if not found:
        return b.select(F.col("item_id").alias("doc_id"), "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0).alias("distance")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # the best window so far of each task meets those of others: one small row a task and pair
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "distance")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).alias("start"), F.col("b.n_words").alias("n_words"), F.col("b.distance").cast("int").alias("distance"))


def _leaks_of(d: DataFrame, b: DataFrame, size: int, n_items: int, n_shingles: int, longest: int, similarity: float, radius: int) -> DataFrame:
    """Windows (doc_id, item_id, similarity, start, n_words, distance) for the items whose shingles have this many words."""
    # 1. where documents share shingles with items, and how long those items are
    shared = b.select(F.explode(F.array_distinct("item")).alias("h"), "m").groupBy("h").agg(F.collect_set("m").alias("ms"))
    seen = d.select("doc_id", _row_hash().alias("row_h"), F.posexplode(hashed(F.col("text"), size)).alias("at", "h"))
    hits = seen.join(small(shared, 100 * n_shingles), "h").groupBy("doc_id", "row_h").agg(F.sort_array(F.collect_set("at")).alias("at"), F.array_distinct(F.flatten(F.collect_set("ms"))).alias("ms"))
    hits = written(hits, "hits")

    # 2. the windows there, with their fingerprints; each is cut out of the document's hashes before rows multiply
    weight = hits.agg(F.coalesce(F.sum(F.lit(64).cast("long") + 4 * (F.size("at") + F.size("ms"))), F.lit(0))).first()[0]
    of = hits.select(F.col("doc_id").alias("of"), F.col("row_h").alias("of_h"), "at", "ms")
    near = d.join(small(of, weight), F.col("doc_id").eqNullSafe(F.col("of")) & (_row_hash() == F.col("of_h")))
    near = near.select("doc_id", "at", "ms", hashed(F.col("text"), size).alias("all"))

    def cut(m: Column) -> Column:
        def one(start: Column) -> Column:
            low = F.greatest(start, F.lit(0))
            return F.struct(m.alias("m"), low.alias("start"), F.slice("all", low + 1, F.least(start + m, F.size("all")) - low).alias("win"))

        return F.transform(_starts(F.col("at"), m, F.size("all"), similarity), one)

    wins = near.select("doc_id", F.explode(F.flatten(F.transform("ms", cut))).alias("w")).select("doc_id", "w.*")
    wins = wins.withColumn("win_print", simhash(F.col("win"), longest))

    # 3. fingerprints within the radius share a block
    tables = b.select("item_id", "item", "m", "print", F.explode(blocks(F.col("print"), radius)).alias("block")).select("item_id", "item", "m", "print", F.col("block.no").alias("no"), F.col("block.value").alias("value"))
    probes = wins.select("doc_id", "m", "start", "win", "win_print", F.explode(blocks(F.col("win_print"), radius)).alias("block")).select("doc_id", "m", "start", "win", "win_print", F.col("block.no").alias("no"), F.col("block.value").alias("value"))
    pairs = probes.join(small(tables, (radius + 1) * (64 * n_items + 8 * n_shingles)), ["m", "no", "value"])
    apart = F.bit_count(F.col("win_print").bitwiseXOR(F.col("print")))
    # of the blocks that a pair shares, the first one speaks for it
    own, theirs = blocks(F.col("win_print"), radius), blocks(F.col("print"), radius)
    first = F.array_position(F.zip_with(own, theirs, lambda x, y: x["value"] == y["value"]), True) - 1
    pairs = pairs.where(apart <= radius).where(first == F.col("no")).withColumn("distance", apart)

    # 4. exact similarity
    inter = F.size(F.array_intersect(_multiset(F.col("win")), _multiset(F.col("item"))))
    alike = pairs.select("doc_id", "item_id", "start", F.size("win").alias("n"), F.size("item").alias("m"), "distance", inter.alias("inter"))
    alike = alike.withColumn("similarity", F.col("inter") / (F.col("n") + F.col("m") - F.col("inter"))).where(F.col("similarity") >= similarity - 1e-12)
    return alike.select("doc_id", "item_id", "similarity", "start", (F.col("n") + size - 1).alias("n_words"), "distance")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, with all their columns, whose document leaks no item.

    Rows that repeat a doc_id go together if one of them leaks; so do rows without a doc_id. Rows with null or blank
    texts stay, unless their document goes. Empty tables are allowed.
    """
    leaks = written(find_leaks(docs, benchmark, similarity, radius).select(F.col("doc_id").alias("leaky")).distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("all"))
    return rows.join(small(leaks, 16 * leaks.count()), F.col("all.doc_id").eqNullSafe(F.col("leaky")), "left_anti").select("all.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "similarity", "start", "n_words")


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Windows without a shared shingle have similarity 0; of the others, those that begin or end at one are as similar as any.
ORACLE_SQL = f"""
with iw as (select row_number() over () as no, item_id, {_WORDS} as w from (select distinct item_id, text from benchmark)),
items as (select no, item_id, least(len(w), {SHINGLE}) as size, len(w) - least(len(w), {SHINGLE}) + 1 as m, w from iw where len(w) > 0),
sizes as (select distinct size from items),
ig as (select no, item_id, size, m, array_to_string(w[i:i + size - 1], ' ') as g from (select *, unnest(range(1, m + 1)) as i from items)),
ic as (select no, size, g, count(*) as c from ig group by no, size, g),
dw as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents where text is not null),
dg as (select rid, size, i - 1 as pos, array_to_string(w[i:i + size - 1], ' ') as g from (select rid, size, w, unnest(range(1, len(w) - size + 2)) as i from dw cross join sizes)),
hits as (select d.rid, d.pos, i.no, i.c, d.g, i.size from dg d join ic i on d.g = i.g and d.size = i.size),
near as (select distinct h.rid, h.no, greatest(s, 0) as a, least(s + t.m, len(dw.w) - t.size + 1) as z, t.m
  from hits h join items t using (no) join dw using (rid), unnest([h.pos, h.pos - t.m + 1]) u(s)),
inter as (select n.rid, n.no, n.a, n.z, n.m, h.g, least(count(*), any_value(h.c)) as c from near n join hits h on h.rid = n.rid and h.no = n.no and h.pos between n.a and n.z - 1 group by all),
alike as (select rid, no, a, z, sum(c)::double / (z - a + m - sum(c))::double as similarity from inter group by rid, no, a, z, m),
found as (select d.doc_id, t.item_id, x.similarity, x.a as start, x.z - x.a + t.size - 1 as n_words from alike x join items t using (no) join dw d using (rid) where similarity >= {SIMILARITY} - 1e-12)
select * from found qualify row_number() over (partition by doc_id, item_id order by similarity desc, start, n_words desc) = 1
"""
