"""Languages in options and file names, and names of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages that have a display name; others show their code in capitals.
LANGUAGE_NAMES = {
    "cmn": "Chinese", "eng": "English", "jpn": "Japanese", "kor": "Korean", "fra": "French",
    "deu": "German", "spa": "Spanish", "ita": "Italian", "rus": "Russian", "ara": "Arabic",
}
KINDS = {"subtitle": ".srt", "dub": ".wav", "clone": ".cloned.wav"}


def language_pair(option: Column) -> Column:
    """struct<source,target> of "a:b": one colon, both sides non-empty after stripping; else null."""
    parts = F.transform(F.split(option, ":", -1), lambda x: F.btrim(x, F.lit(" \t\n\r")))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when((F.size(parts) == 2) & (a != "") & (b != ""), F.struct(a.alias("source"), b.alias("target")))


def languages_of_stem(stem: Column) -> Column:
    """struct<source,target> of a file name without its suffix that ends in .xx-yy (2 or 3 small letters each); else null.

    A further ".refined" is skipped.
    """
    pattern = r"\.([a-z]{2,3})-([a-z]{2,3})(?:\.refined)?$"
    a = F.regexp_extract(stem, pattern, 1)
    return F.when(a != "", F.struct(a.alias("source"), F.regexp_extract(stem, pattern, 2).alias("target")))


def languages_of_file(name: Column) -> Column:
    """struct<first,second> of a name that ends in .xxx-yyy.srt (or .xxx-yyy.refined.srt), any case; else null."""
    pattern = r"(?i)\.([a-z]{3})-([a-z]{3})(?:\.refined)?\.srt$"
    a = F.regexp_extract(name, pattern, 1)
    return F.when(a != "", F.struct(F.lower(a).alias("first"), F.lower(F.regexp_extract(name, pattern, 2)).alias("second")))


def language_table(spark: SparkSession) -> DataFrame:
    """code, name: ten rows."""
    return spark.createDataFrame(list(LANGUAGE_NAMES.items()), "code string, name string")


def with_language_name(df: DataFrame, code: str, out: str) -> DataFrame:
    """df with the display name of a code column; unknown codes in capitals. The joined table has ten rows."""
    names = F.broadcast(language_table(df.sparkSession).select(F.col("code").alias("_code"), F.col("name").alias("_name")))
    return df.join(names, F.col(code) == F.col("_code"), "left").withColumn(out, F.coalesce("_name", F.upper(code))).drop("_code", "_name")


def output_name(stem: Column, source: Column, target: Column, kind: str = "subtitle", bilingual: bool = False) -> Column:
    """stem.source-target.srt for bilingual subtitles, else stem.target and the suffix of the kind."""
    if kind == "subtitle" and bilingual:
        return F.concat(stem, F.lit("."), source, F.lit("-"), target, F.lit(KINDS[kind]))
    return F.concat(stem, F.lit("."), target, F.lit(KINDS[kind]))


def refined_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.srt$", ""), F.lit(".refined.srt"))


def fragment_name(media_id: Column, frag_id: Column, start_ms: Column, end_ms: Column) -> Column:
    """Names by whole milliseconds and id, so that no two fragments share one."""
    return F.format_string("%s_%06d_%010d_%010d.wav", media_id, frag_id, start_ms, end_ms)
