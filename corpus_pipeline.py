"""A training corpus from documents: quality rules, line dedup, near-dedup, decontamination, mixing.

Part of subpackage llm. Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents, in which the stage's decisions have taken effect. A stage sees only what its
predecessor kept. Columns beyond those of documents are left out, whatever their names; a missing one is null. Empty tables
pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import discard, pick, scope, table, written  # noqa: F401  written is for callers that run the stages themselves
from cuelake.llm.decontam import decontaminate
from cuelake.llm.line_dedup import line_dedup
from cuelake.llm.mixing import mix_sources
from cuelake.llm.near_text import keep_one_text
from cuelake.llm.quality_rules import fit, keep_good

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go. Rules are learned from labels of the documents given.

    A null, empty or blank text goes; rows that repeat a doc_id, and rows without one, are judged one by one.
    """
    docs = pick(docs, *COLUMNS)
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common to many documents go, but for one document; n_chars is counted anew where lines went.

    A null text stays null. A row without doc_id loses nothing and counts for no line; rows that repeat a doc_id are one
    document. The largest doc_id keeps a common line, every time it holds it.
    """
    out = line_dedup(pick(docs, *COLUMNS))
    hit = F.col("n_dropped") > 0
    return out.select(
        "doc_id", F.when(hit, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(hit, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at similarity 0.8 or more (shingles of five words) the smallest doc_id stays.

    Of rows that repeat it, one stays. Null and blank texts are alike. Rows without doc_id stay only where their group has
    no doc_id at all.
    """
    return keep_one_text(pick(docs, *COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id; null texts hold none, null items match nothing."""
    return decontaminate(pick(docs, *COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to equal weights; a row per copy, in shuffled order, with n_copies, copy, rate and mix_key.

    Rows that repeat a doc_id, or have none, share one draw. A null source is a source of its own.
    """
    return mix_sources(pick(docs, *COLUMNS))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SimHash grouping and learned rules can't be stated in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way goes once its result is written, and that once the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scope() as outside:
            docs = outside(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
