"""Line deduplication across documents, with DataFrame functions only.

Lines are keyed by a 128-bit hash. One scan of the texts writes a row per line; these rows are range-partitioned by
(hash, document) and sorted by (hash, document, position), so one hash that is in a third of all documents is spread
over many tasks. Each task streams its sorted run: the first occurrence of a hash in a document counts once, and a
task sends one partial count per hash. The sorted runs, as a table, then meet the common keys. What comes back for a
document is a run-length bitmap of the lines it loses, not its text; a second scan applies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, discard, partitions, pick, table, text_key, written

MIN_CHARS, MIN_DOCS = 40, 5


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the documents that lose lines: doc_id, row_h, row_n, runs array<struct<first:int,last:int>>.

    A key (stripped, A-Z in lower case, at least min_chars code points) found in at least min_docs documents
    loses all lines except those in the largest doc_id that holds it.
    Rows alike in doc_id and text have one bitmap, told by a hash and the length of the text (row_h, row_n).
    Null or empty text is one empty line and loses nothing. A null doc_id is no document: it counts for no key
    and loses nothing. Rows that repeat a doc_id are one document. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    d = pick(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    lines = d.select("doc_id", *text_key(F.col("text"), "row_h", "row_n"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.where(F.length("line") >= min_chars).withColumn("line", F.btrim("line", F.lit(SPACE))).where(F.length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    # written first: the sampling of range borders would else scan and split the texts once more
    found = written(lines.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), "doc_id", "pos", "row_h", "row_n"), "lines")
    # ranges of (hash, document) hold all of a document's occurrences of a hash, so the window below needs no exchange
    runs = found.repartitionByRange(partitions(spark), "h1", "h2", "doc_id")
    order = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos", "row_h", "row_n")
    runs = written(runs.withColumn("first", F.row_number().over(order) == 1), "runs")
    discard(found)
    common = runs.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    # read as a table, the common keys are a side of their own exchange, and a hot key's rows can be split in the join
    lost = runs.join(written(common, "common"), ["h1", "h2"]).where(F.col("doc_id") < F.col("keeper"))
    lost = lost.groupBy("doc_id", "row_h", "row_n").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    first = F.filter("lost", lambda p, i: (i == 0) | (F.get(F.col("lost"), i - 1) != p - 1))
    last = F.filter("lost", lambda p, i: (i == F.size("lost") - 1) | (F.get(F.col("lost"), i + 1) != p + 1))
    return lost.select("doc_id", "row_h", "row_n", F.arrays_zip(first.alias("first"), last.alias("last")).alias("runs"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with n_lines, n_dropped, runs (the lines lost, as run-length bitmap) and kept_text added.

    All columns of docs stay, but for those with these four names, which are replaced. See drop_bitmaps for
    nulls, ties, repeated rows and empty tables; a null text has kept_text "".
    """
    own = ("n_lines", "n_dropped", "runs", "kept_text")
    maps = drop_bitmaps(docs, min_chars, min_docs)
    maps = maps.select(F.struct("doc_id", "row_h", "row_n").alias("of"), F.col("runs").alias("lost_runs"))
    rows = docs.select(F.struct("*").alias("all"))
    text = F.coalesce(F.col("all.text"), F.lit(""))
    rows = rows.select("all", *text_key(F.col("all.text"), "row_h", "row_n"))
    o = F.col("of")
    joined = rows.join(maps, (F.col("all.doc_id") == o["doc_id"]) & (F.col("row_h") == o["row_h"]) & (F.col("row_n") == o["row_n"]), "left")
    joined = joined.withColumn("lines", split_lines(F.col("all.text")))
    runs, lines = F.col("lost_runs"), F.col("lines")
    empty = F.array().cast("array<int>")
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    gaps = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))
    dropped = F.aggregate(runs, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    none = runs.isNull()
    return joined.select(
        *[F.col("all")[c].alias(c) for c in docs.columns if c not in own],
        F.size(lines).cast("long").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(dropped).cast("long").alias("n_dropped"),
        F.coalesce(runs, F.array().cast("array<struct<first:int,last:int>>")).alias("runs"),
        F.when(none, text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


_KEY = "translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shared with the pipeline's SQL: the kept text of each document of a relation named docs.
KEPT_SQL = f"""
numbered as (select row_number() over () as rid, * from docs),
lines as (select rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from numbered),
keyed as (select *, {_KEY} as key from lines),
common as (select key, max(doc_id) as keeper from keyed where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) >= {MIN_DOCS}),
marked as (select k.*, coalesce(k.doc_id < c.keeper, false) as lost from keyed k left join common c on k.key = c.key),
kept as (select rid, count(*) as n_lines, count(*) filter (lost) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '') as kept_text from marked group by rid)
"""

ORACLE_SQL = f"""
with docs as (select * from documents), {KEPT_SQL}
select n.doc_id, k.n_lines, k.n_dropped, sha256(k.kept_text) as kept_sha256
from numbered n join kept k using (rid)
"""
